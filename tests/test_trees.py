"""Metric trees of different shape and depth against the definition."""

import json
import random

from pagemill.operators import compare


def differ(a, b, path=()):
    if isinstance(a, dict) and isinstance(b, dict):
        for key in sorted({*a, *b}):
            yield from differ(a.get(key), b.get(key), (*path, key))
    else:
        number = lambda x: float(x) if isinstance(x, (int, float)) else None
        x, y = number(a), number(b)
        yield ".".join(path), x, y, None if x is None or y is None else y - x


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2.5, -3, 10**12, 0.1, "text", None, True, False, [1, {"x": 2}], {}])
    return {rng.choice("abcd") + rng.choice(["", "é", " x"]): tree(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_trees(spark):
    rng = random.Random(4)
    pairs = {str(i): ({"r": tree(rng, 4)}, {"r": tree(rng, 4), "only": 1}) for i in range(60)}
    pairs |= {"same": ({"a": {"b": {"c": {"d": {"e": 1}}}}}, {"a": {"b": {"c": {"d": {"e": 4}}}}}), "leaf and tree": ({"a": 1}, {"a": {"b": 2}}), "none": ({}, {})}
    sides = [spark.createDataFrame([(k, json.dumps(v[s])) for k, v in pairs.items()] + [("broken", "{no" if s else '{"a": 1}')], "id string, tree string") for s in (0, 1)]
    got = sorted((r.id, r.path, r.left, r.right, r.delta) for r in compare.metric_tree_diff(*sides).collect())
    want = sorted((k, *row) for k, (a, b) in {**pairs, "broken": ({"a": 1}, {})}.items() for row in differ(a, b))
    key = lambda rows: sorted(rows, key=repr)
    assert key(got) == key(want) and len(want) > 150


def test_trees_of_clicks_are_dealt_in_bounded_parts(spark, small, monkeypatch):
    """A larger table has more parts, not larger ones."""
    import os

    from pagemill.plans import q_eval

    monkeypatch.setattr(q_eval, "PART_BYTES", 2000, raising=False)
    out = q_eval.metric_tree_json_diff(spark, small)
    assert out.rdd.getNumPartitions() >= os.path.getsize(f"{small}/clicks.parquet") // 8000
    assert out.count() > 0
