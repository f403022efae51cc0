"""All queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from pagemill.plans import q_eval, q_plans, q_ranking, q_rel, q_text  # noqa: F401  (registers its queries)
from pagemill.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
