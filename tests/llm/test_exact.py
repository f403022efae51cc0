"""Operators with exact results against brute force: 1, 2, 3, 9, 10 and the graph and coding kernels."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import brown_lm, quality, simhash, suffix_dedup, token_store

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def key(i):
    return -(2**63) if i is None else i


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1, 3])
def test_suffix_dedup(documents, rows, hot):
    first: dict = {}
    for r in rows:
        b = (r.text or "").encode()
        for w in {b[s : s + 50] for s in range(len(b) - 49)}:
            first[w] = min(first.get(w, key(r.doc_id)), key(r.doc_id))
    want = Counter()
    for r in rows:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key(r.doc_id):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(r.doc_id, len(b), sum(gone), sum(bool(x) for x in bytes(gone).split(b"\0")), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.remove_repeats(documents, hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0
    assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=8), max_size=7))
def test_loser_tree_merges_front_coded_runs(lists):
    runs = [sorted((x, b"", 0, 0, i) for x in own) for i, own in enumerate(lists)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.read_run(suffix_dedup.front_coded(r)) for r in runs]))
    words = [row[1] for _, _, row in merged]
    assert words == sorted(x for own in lists for x in own)
    for a, b, (_, n, _) in zip(words, words[1:], merged[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i, run in enumerate(runs):
        assert [row[1] for r, _, row in merged if r == i] == [x[0] for x in run]


def test_token_store(documents, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    start, want = 0, []
    for r in sorted(rows, key=lambda r: (key(r.doc_id), r.text or "")):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_store.tokenize_and_read(documents, VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_stored_ids(spark, documents):
    path = token_store.store_path(spark)
    token_store.write_tokens(documents.where("doc_id = 900004"), path, VOCABULARY)
    assert [r.ids[-1] for r in token_store.token_ids(spark, path).collect()] == [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**32 - 1), st.sampled_from([0, 1, 32766, 32767, 32768])), min_size=1, max_size=150), min_size=1, max_size=6))
def test_simple8b_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    sizes = np.array([len(d) for d in docs])
    words, n_words, escapes, n_escapes = token_store.pack(ids, sizes)
    assert (token_store.unpack(words, n_words, sizes, escapes) == ids).all()
    assert n_words.sum() == len(words) and n_escapes.sum() == len(escapes)
    last = np.cumsum(n_words)[-1]
    assert (token_store.unpack(words[last - n_words[-1] :], n_words[-1:], sizes[-1:], escapes[len(escapes) - n_escapes[-1] :]) == docs[-1]).all()


def test_language_model(documents, rows):
    tokens = [((r.text or "").encode().translate(LOWER).split() + [b"\0end"], r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2, r.doc_id) for r in rows]
    count = Counter(w for t, held, _ in tokens if not held for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, held, len(t), sum(count[w] > 0 for w in t), n) for t, held, i in tokens)
    base = {(i, len(t)): sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t) for t, _, i in tokens}
    got = brown_lm.score(documents).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    assert all(r.base_score == pytest.approx(base[r.doc_id, r.n_tokens], rel=1e-9) for r in got)
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_scores_by_hand(documents, rows):
    """The whole model again, word by word: core, class-count vectors, sweeps, weight."""
    texts = [(r.text or "").encode() for r in rows]
    ids = [brown_lm.tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 0, 1)[0].tolist() for t in texts]
    rest = [None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 7 for r in rows]
    train = [t for t, x in zip(ids, rest) if x != 2]
    end = int(brown_lm.END)
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    often = [w for w in count if w != end and count[w] * brown_lm.COMMON * brown_lm.CORE >= n]
    core = sorted([*sorted(often, key=lambda w: (-count[w], signed(w)))[: brown_lm.CORE], end])
    at = {w: i for i, w in enumerate(core)}
    bigrams = np.zeros((len(core), len(core)), np.float32)
    for t in train:
        for a, b in zip([end, *t], t):
            if a in at and b in at:
                bigrams[at[a], at[b]] += 1
    of = brown_lm.exchange(bigrams, min(brown_lm.CLASSES, len(core)))
    k = int(of.max()) + 1
    cls = {w: int(of[i]) for w, i in at.items()}
    others = sorted(w for w in count if w not in at)
    assert len(others) > 1000
    place = {w: i for i, w in enumerate(others)}
    vectors = np.zeros((len(others), 2 * k))
    for t in train:
        for a, b, c in zip([end, *t], t, [*t[1:], None]):
            if b in place:
                if a in at:
                    vectors[place[b], cls[a]] += 1
                if c in at:
                    vectors[place[b], k + cls[c]] += 1
    core_moves = np.zeros((k, k))
    for i, j in zip(*np.nonzero(bigrams)):
        core_moves[of[i], of[j]] += bigrams[i, j]
    model = brown_lm.Model(core_moves, np.maximum(core_moves.sum(0), 1))
    for _ in range(brown_lm.WORD_SWEEPS):
        own = model.classes(vectors, np.array([count[w] for w in others]))
        moves, mass = core_moves.copy(), np.zeros(k)
        for w in core:
            mass[cls[w]] += count[w]
        for i, w in enumerate(others):
            mass[own[i]] += count[w]
            moves[:, own[i]] += vectors[i, :k]
            moves[own[i]] += vectors[i, k:]
        model = brown_lm.Model(moves, np.maximum(mass, 1))
    cls |= {w: int(c) for w, c in zip(others, own)}

    def scored(t, weight, left_out):
        out, before = 0.0, cls[end]
        for w in t:
            c, m = cls.get(w), count[w]
            if left_out:
                classed = (max(model.moves[before, c] - 1, 0) + brown_lm.ALPHA) / (max(model.moves[before].sum() - 1, 0) + brown_lm.ALPHA * k) * (m - 1) / max(model.mass[c] - 1, 1)
                plain = m / (n + v)
            else:
                classed = 0.0 if c is None else (model.share[c] if before is None else model.transition[before, c]) * m / model.mass[c]
                plain = (m + 1) / (n + v + 1)
            out += math.log10(weight * classed + (1 - weight) * plain)
            before = c
        return out

    total = {w: sum(scored(t, w, True) for t, x in zip(ids, rest) if x == brown_lm.CHECKED) for w in brown_lm.WEIGHTS}
    weight = max(total, key=total.get)
    got = defaultdict(list)
    for r in brown_lm.score(documents).collect():
        assert r.weight == weight
        got[r.doc_id, r.n_tokens].append(r.score)
    for r, t in zip(rows, ids):
        assert min(abs(x / scored(t, weight, False) - 1) for x in got[r.doc_id, len(t)]) < 1e-6


def test_transitions_of_every_pair(spark, monkeypatch):
    """Pairs without a core word are counted too."""
    monkeypatch.setattr(brown_lm, "CORE", 2)
    docs = spark.createDataFrame([(i, "the a the b " + " ".join(f"{x}{(i + j) % 40}" for j in range(30) for x in "uv")) for i in range(60)], "doc_id long, text string")
    some, every = (sum(r.score for r in brown_lm.score(docs, every_pair=x).collect() if r.held_out) for x in (False, True))
    assert every > some
    cls, first = np.array([0, 1, -1, 1, 0]), np.array([0, 2, 5])
    assert brown_lm.pairs_of(cls, first, 2, 3).tolist() == [6, 1, 3]


def test_language_model_without_training(spark, documents):
    none = documents.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    got = brown_lm.score(none).collect()
    assert got and all(r.n_known == r.train_tokens == r.base_score == 0 for r in got)


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    kind = rng.permutation(np.arange(40) % 2)
    counts = np.where(kind[:, None] != kind[None, :], rng.poisson(50, (40, 40)), 0)
    of = brown_lm.exchange(counts, 2)
    assert len({(a, b) for a, b in zip(of, kind)}) == 2


def test_class_model_is_a_distribution(documents):
    """Transitions times emissions sum to one over the training vocabulary: scores cannot be inflated."""
    rng = np.random.default_rng(2)
    bigrams = rng.poisson(2, (12, 12))
    of = brown_lm.exchange(bigrams, 3)
    member = np.eye(3)[of]
    moves = member.T @ bigrams @ member
    assert np.allclose(((moves + brown_lm.ALPHA) / (moves.sum(1, keepdims=True) + 3 * brown_lm.ALPHA)).sum(1), 1)


def brute_quality(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen: set = set()
    dup = sum(x in seen or seen.add(x) is not None for x in lines)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(documents, rows):
    want = Counter((r.doc_id, *brute_quality(r.text)) for r in rows)
    got = quality.judged(documents).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert {(r.doc_id, r.kept) for r in got} == {(r.doc_id, r.kept) for r in quality.judged(documents.repartition(2)).collect()}


def test_sketch_quartiles(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(2, 3, 5000)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double").selectExpr("g", "false as base_failed", *[f"v as {m}" for m in quality.MEASURES])
    q = quality.quartiles(quality.merged(quality.sketches(df, ["g"]), ["g"]), ["g"]).where("measure = 'symbol_ratio'").first()
    for got, want in ((q.q1, np.quantile(x, 0.25)), (q.q3, np.quantile(x, 0.75))):
        assert abs(got - want) <= 0.03 * want


def test_labelled_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judged(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def brute_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(documents, rows):
    fps = [brute_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    group: dict = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            group[find(i)] = min(group.get(find(i), r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", group.get(find(i))) for i, (r, f) in enumerate(zip(rows, fps)))
    assert Counter(tuple(r) for r in simhash.near_duplicates(documents).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_covering_masks():
    """Every set of three positions is left out by some table: no pair within the radius is lost."""
    from itertools import combinations

    masks = simhash.masks()
    assert len(masks) == 15
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in combinations(range(64), 3))


@pytest.mark.parametrize("n", [50, 5000])
def test_large_buckets_lose_no_link(n):
    rng = np.random.default_rng(n)
    free = simhash.masks()[0] ^ (2**64 - 1)
    bits = [i for i in range(64) if free >> i & 1]
    base = [sum(1 << int(b) for b in rng.choice(bits, 9, replace=False)) for _ in range(n // 5)]
    fps = np.unique(np.array([b ^ sum(1 << int(x) for x in rng.choice(bits, k, replace=False)) for b in base for k in (0, 1, 2, 3, 3)], np.uint64))

    def groups(edges):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges.tolist():
            root[find(a)] = find(b)
        return Counter(Counter(map(find, root)).values())

    kept = simhash.SMALL_BUCKET
    found = {}
    for limit in (1, 10**9):
        simhash.SMALL_BUCKET = limit
        found[limit] = groups(simhash.bucket_edges(fps, free))
    simhash.SMALL_BUCKET = kept
    assert found[1] == found[10**9]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, j) for j in range(1001, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and {got.get(i, i) for i in range(1000, 1060)} == {1000}


def test_one_of_each_group_stays(documents):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    all_groups = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {i for i in ids if i is not None} <= all_groups | {900001}


def test_empty_tables(none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert token_store.tokenize_and_read(none, VOCABULARY).count() == 0
    assert brown_lm.score(none).count() == 0
    assert quality.judged(none).count() == quality.quality_filter(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
