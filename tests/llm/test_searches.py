"""Operators 11, 12 and 13 against brute force: hard negatives, row patterns, near-duplicates by sketches."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from pagemill.llm import hard_negatives, minhash, row_pattern

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def many_partitions(spark):
    """Small tables dealt over partitions that adaptive execution leaves apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


# -- operator 12

CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, part string, seq int, chain int, id string, `key` int"


def clicks_of(seed):
    rng = random.Random(seed)
    rows, start = [], datetime(2024, 3, 31, 1, 50)  # an hour that local clocks skip
    for client, n, calm in ((1, 150, True), (2, 60, False), (3, 25, False), (None, 9, False), (4, 1, False)):
        t = start
        for i in range(n):
            t += timedelta(seconds=0 if rng.random() < 0.15 else rng.choice([1, 60, 899, 900, 30]), microseconds=rng.choice([0, 0, 1])) if calm or rng.random() < 0.8 else timedelta(hours=1)
            value = round(float(rng.randint(1, 8)) + rng.choice([0, 0.004, 0.005, 0.01]), 3)
            kind = "view" if calm and i % 3 == 0 else rng.choice(["view", "click", "signup"])
            if not calm and rng.random() < 0.2:
                kind, value = rng.choice([("error", 9.0), (None, 2.0), ("view", None), ("view", NAN), ("view", INF), ("view", -0.0)])
            rows.append((None if client == 3 and i == 7 else len(rows), None if client == 2 and i == 5 else t, client, kind, value, "x", i % 2, 1, "y", 2))
    rows += [r for r in rows if rng.random() < 0.1]  # the same rows again
    rng.shuffle(rows)
    return rows


def matches_of(rows):
    """A matcher that backtracks as a regular expression does."""
    keyed = defaultdict(list)
    for r in {tuple("nan" if x != x else x for x in r) for r in rows if r[2] is not None and r[1] is not None}:
        keyed[r[2]].append(r)
    out = []
    for client, own in keyed.items():
        own.sort(key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        cents = [None if r[4] in (None, "nan", INF, -INF) else math.floor(100 * r[4] + 0.5) for r in own]

        def fits(letter, i, a):
            if not i < len(own) or cents[i] is None or own[i][1] - own[i - 1][1] > timedelta(minutes=15):
                return False
            if letter == "P":
                return own[i][3] == "view" and cents[i] >= a
            if cents[i - 1] is None or own[i][3] in (None, "error"):
                return False
            return cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1]

        def rest(state, i, a):
            for letter in "DU" if state == 1 else "D":
                if fits(letter, i, a) and (more := rest(state, i + 1, a)) is not None:
                    return letter + more
            if state == 2:
                return ""
            return "P" + rest(2, i + 1, a) if fits("P", i, a) else None

        s, no = 0, 0
        while s < len(own):
            more = None if cents[s] is None else rest(1, s + 1, cents[s])
            if more is None:
                s += 1
                continue
            no, e = no + 1, s + len(more)
            out.append((client, no, own[s][0], own[e][0], e - s + 1, sum(cents[s : e + 1]), "A" + more))
            s = e
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_row_pattern(spark, many_partitions, seed):
    rows = clicks_of(seed)
    got = row_pattern.find_matches(spark.createDataFrame(rows, CLICKS).repartition(3)).collect()
    want = matches_of(rows)
    assert sorted(map(tuple, got)) == want
    assert len(want) > 10 and any("P" in w[6][:-1] and len(w[6]) > 3 for w in want)


def test_row_pattern_over_whole_tasks_without_a_break(spark, many_partitions):
    """One key whose rows never break: the chain goes through every task."""
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(seconds=i), 5, "view" if i % 4 == 0 else "click", float(i % 9 + (i * 7) % 5), "x", 1, 1, "y", 2) for i in range(300)]
    rows = [r for i, r in enumerate(rows) if i == 0 or r[4] != rows[i - 1][4]]
    got = row_pattern.find_matches(spark.createDataFrame(rows, CLICKS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == matches_of(rows)


def test_row_pattern_of_nothing(spark):
    got = row_pattern.find_matches(spark.createDataFrame([], CLICKS))
    assert got.columns == ["client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels"] and not got.count()


def test_best_is_what_can_still_succeed():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        cents, moves, peak = rng.integers(0, 9, n), rng.random(n) < 0.8, rng.random(n) < 0.4
        want, after = [0] * n, row_pattern._LEAST
        for i in range(n - 1, -1, -1):
            after = max(int(cents[i]) if peak[i] else row_pattern._LEAST, after if moves[i] else row_pattern._LEAST)
            want[i] = after
        assert row_pattern.best_of(cents, moves, peak).tolist() == want


# -- operator 11

VECTORS = "vec_id long, embedding array<float>, label int, `key` int, block string, payload string"


def vectors(seed, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        v = (rng.choice([-0.5, 0.25, 0.5, 0.75, 1.0], 6) * scale).astype("f4").tolist()
        rows.append((i, v, int(rng.integers(0, 10)), 1, "x", "y"))
    odd = [(None, [0.1] * 6, 1), (1000, None, 2), (1050, [0.1] * 6, None), (1100, [None] + [0.1] * 5, 3), (1150, [NAN] * 6, 3), (1200, [INF] + [0.0] * 5, 3), (1250, [], 4), (1300, [0.5] * 3, 4), (-50, [1.0] * 6, 2), (-7, [1.0] * 6, 9)]
    rows += [(*r, 1, "x", "y") for r in odd]
    rows += rows[:5] + [(50, [1.0] * 6, 6, 1, "x", "y"), (51, [1.0] * 6, 6, 1, "x", "y")]  # repeats, and ids that two rows share
    return rows


def mined(rows):
    own = set()
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.add((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in own:
        if a[0] % 50 == 0:
            ranked = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in own if b != a))
            for p, pid, _ in [r for r in ranked if r[2] == a[1]][:5]:
                fit = [r for r in ranked if r[2] != a[1] and 50 * -p <= 100 * -r[0] <= 95 * -p][:3]
                out += [(a[0], pid, k, n, -p, -s) for k, (s, n, _) in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 100.0, 1e6])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 4)
    rows = vectors(int(scale) % 5, scale)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want = mined(rows)
    assert Counter(map(tuple, got)) == want and len(want) > 60


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, 1, "x", "y")], VECTORS)).collect() == []


# -- operator 13


def sets_of(rows):
    out = []
    for r in rows:
        w = (r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def near_of(rows):
    sets = sets_of(rows)
    distinct = list({s for s in sets if s})
    by, parent = defaultdict(list), {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for s in distinct:
        for x in s:
            by[x].append(s)
    for s in distinct:
        for other, both in Counter(id(o) for x in s for o in by[x]).items():
            o = next(o for x in s for o in by[x] if id(o) == other) if both * 100 >= 85 * len(s) else None
            if o is not None and 100 * both >= 85 * (len(s) + len(o) - both):
                parent[root(s)] = root(o)
    low = defaultdict(list)
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            low[root(s)].append(r[0])
    out = Counter()
    for r, s in zip(rows, sets):
        c = min(low[root(s)], default=None) if s else r[0]
        out[r[0], len(s), c, r[0] == c] += 1
    return out


def near_texts(seed):
    """Groups of copies that differ here and there: some at the limit, in chains, beside groups of half the likeness."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("rstlmn")
    out = []
    for n, copies, changes in ((400, 60, 3), (300, 25, 9), (120, 30, 2), (40, 20, 1), (900, 6, 14), (60, 40, 6)):
        base = [word() for _ in range(n)]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(n)] = word()
            out.append((1000 * len(out) % 7919 + len(out), " ".join(own)))
            if c % 9 == 0:
                base = own  # the group drifts
    return [*out, *out[:4], (None, out[3][1]), (None, "a lonely text without an id, of its own"), (None, None), (7777, None), (7778, " \n"), (7779, "one"), (7780, "ONE"), (7781, "one two"), (7782, out[0][1].upper())]


@pytest.mark.parametrize("seed", range(2))
def test_minhash(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "SLICE", 8)  # groups of several slices
    monkeypatch.setattr(minhash, "FIRST_BANDS", 1)
    rows = near_texts(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = near_of(rows)
    assert Counter(map(tuple, got)) == want
    assert sum(not kept for _, _, _, kept in want) > 80


def test_minhash_on_documents(documents, rows):
    got = minhash.near_duplicates(documents).collect()
    assert Counter(map(tuple, got)) == near_of([(r.doc_id, r.text) for r in rows])


def test_minhash_of_nothing(none):
    assert minhash.near_duplicates(none).collect() == []


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [x[:1], x[:3], x[:50], x[:2000], x[1000:3000], x[:0]]
    s = minhash.sketches(sets)
    assert (s[:5] != minhash._EMPTY).all() and (s[5] == minhash._EMPTY).all()
    assert (s[0] >> np.uint64(32)).max() <= 2 * minhash.BINS
    assert abs((s[3] == s[4]).mean() - 1 / 3) < 0.15
    one = minhash.sketches([x[:3]])
    assert (one[0] == s[1]).all()  # not by the company it keeps


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 200, 257, 300, 3000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for gone in (0, 1, n // 9):
            y = np.sort(np.append(x[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)))
            part = minhash._Slice([1], [1], [len(y)], [minhash.parity_map(y).tobytes()])
            near = part.near(len(x), minhash.parity_map(x), np.ones(1, bool), False)
            assert len(near) or not minhash.linked(x, y)
