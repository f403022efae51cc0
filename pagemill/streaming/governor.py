"""The runtime governor (I1) on a stream: one latch per run, kept as state.

Steps of a run arrive in event-time order within a micro-batch; the state is the
number of steps, the elapsed seconds and the latch, so it is bounded per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run string, event_id long, done long, elapsed double, projected double, fast boolean"
STATE = "done long, elapsed double, fast boolean"


def govern(steps: DataFrame, total: int, budget_seconds: float = 8.5 * 3600, warm_up: int = 25) -> DataFrame:
    """``steps``: streaming (run string, ts timestamp, event_id long, seconds double); adds the latch to each."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, elapsed, fast = state.get if state.exists else (0, 0.0, False)
        for pdf in [pd.concat(list(batches))]:
            rows = []
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                done, elapsed = done + 1, elapsed + float(r.seconds)
                projected = elapsed + elapsed / done * max(total - done, 0)
                fast = bool(fast or (done >= warm_up and round(projected, 6) > budget_seconds))
                rows.append((key[0], int(r.event_id), done, elapsed, projected, fast))
            state.update((done, elapsed, fast))
            yield pd.DataFrame(rows, columns=["run", "event_id", "done", "elapsed", "projected", "fast"])

    return steps.groupBy("run").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
