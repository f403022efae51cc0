"""Operators 4 to 8: mixing, fuzzy passages, decontamination, languages, pages; and the pipeline."""

import html
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import chain_dedup, common, decontam, html_extract, langid, mixing

SF = "/root/testdata/sf0.01"


def targets(rows):
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode().split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, goal, open_ = 1.5 * sum(size.values()), {}, set(names)
    while True:
        rest = total - sum(goal.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            return size, goal | share
        goal |= {s: 2 * size[s] for s in over}
        open_ -= set(over)


def test_mixing(documents, rows):
    size, goal = targets(rows)
    got = mixing.mix(documents).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source], rel=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    biggest = {s: max(len((r.text or "").encode().split()) for r in rows if r.source == s) for s in size}
    assert all(abs(taken[s] - goal[s]) <= 1.5 * biggest[s] for s in size)
    again = mixing.mix(documents.repartition(3)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    pi, x = rng.uniform(0.05, 0.95, 3000), rng.gamma(2, 200, 3000).round()
    out = mixing.flight(pi, x, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum(), abs=1e-4) and (out * x).sum() == pytest.approx((pi * x).sum(), rel=1e-6)
    assert set(np.unique(mixing.landing(out, x))) <= {0.0, 1.0}


def test_flight_is_fair():
    pi, x = np.full(60, 0.3), np.arange(60) % 7 + 1.0
    mean = np.mean([mixing.landing(mixing.flight(pi, x, np.random.default_rng(s)), x) for s in range(400)], 0)
    assert abs(mean - 0.3).max() < 0.15


def test_mix_repeats_documents(documents):
    copies = Counter()
    for r in mixing.mix(documents, key=F.xxhash64("doc_id", "text", "source")).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +copies


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_repeated_passages_are_found(spark, documents, rows):
    got = defaultdict(list)
    for r in chain_dedup.fuzzy_repeats(documents).collect():
        got[r.doc_id].append(r)
    first: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id)):
        w = words_of(r.text)
        for i in range(len(w) - 50):
            first.setdefault(tuple(w[i : i + 51]), r.doc_id)
    for r in rows:
        w = words_of(r.text)
        covered = set()
        for i in range(len(w) - 50):
            if first[tuple(w[i : i + 51])] != r.doc_id:
                covered.update(range(i, i + 51))
        assert any(g.n_words == len(w) for g in got[r.doc_id])
        assert max(g.n_dup_words for g in got[r.doc_id]) >= 0.9 * len(covered)


def test_fuzzy_passage(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = [word() for _ in range(90)]
    changed = list(passage)
    for i in (20, 41, 63):
        changed[i] = word()
    del changed[52]
    clean = " ".join(word() for _ in range(200))
    a = " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])
    b = " ".join([word() for _ in range(30)] + changed + [word() for _ in range(80)])
    df = spark.createDataFrame([(1, a), (2, b), (3, clean)], "doc_id long, text string")
    found = chain_dedup.passages(df)[1].collect()
    assert [(r.doc_id, r.source) for r in found] == [(2, 1)]
    assert abs(found[0].start - 30) <= 1 and abs(found[0].end - 119) <= 1 and found[0].common >= 84


@pytest.mark.parametrize("own_gap,other_gap", [(110, 110), (150, 0), (0, 150)])
def test_two_passages_of_the_same_documents(spark, own_gap, other_gap):
    rng = np.random.default_rng(15)
    some = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    p, q = some(60), some(60)
    a, b = some(20) + p + some(other_gap) + q + some(20), some(35) + p + some(own_gap) + q + some(15)
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    found = sorted((r.start, r.end, r.source_start, r.source_end, r.common) for r in chain_dedup.passages(df)[1].collect())
    assert found == [(35, 95, 20, 80, 60), (95 + own_gap, 155 + own_gap, 80 + other_gap, 140 + other_gap, 60)]


def edited(rng, passage, share, word):
    """A passage with ``share`` of its words replaced, left out or preceded by another word."""
    out = list(passage)
    for i in sorted(rng.choice(len(passage), round(share * len(passage)), replace=False).tolist(), reverse=True):
        out[i : i + 1] = ([word()], [word()], [word()], [], [word(), out[i]])[rng.integers(5)]
    return out


@pytest.mark.parametrize("share,least", [(0.1, 0.95), (0.2, 0.95), (0.28, 0.6)])
def test_recall_of_edited_passages(spark, share, least):
    rng = np.random.default_rng(25)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, want = [], set()
    for i in range(60):
        passage = [word() for _ in range(70)]
        other = edited(rng, passage, share, word)
        if chain_dedup.common(passage, other) >= chain_dedup.IDENTITY * max(len(passage), len(other)):
            want.add((2 * i + 1, 2 * i))
        rows += [(2 * i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(40)])), (2 * i + 1, " ".join([word() for _ in range(50)] + other + [word() for _ in range(20)]))]
    got = {(r.doc_id, r.source) for r in chain_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    print("recall", share, len(got & want) / len(want), "of", len(want))
    assert len(want) >= 50 and len(got & want) >= least * len(want) and all(a == b + 1 for a, b in got)


def test_passage_of_three_owners(spark):
    rng = np.random.default_rng(35)
    some = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    parts = [some(20) for _ in range(3)]
    texts = [some(30) + p + some(30) for p in parts] + [some(25) + sum(parts, []) + some(35), some(40) + sum(parts, []) + some(10)]
    found = chain_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))[1].collect()
    assert [(r.doc_id, r.source, r.start, r.end, r.common) for r in found] == [(4, 3, 40, 100, 60)]


def test_passage_whose_seeds_others_have(spark):
    """Two documents share 64 words; short slices of them stand in earlier documents."""
    rng = np.random.default_rng(36)
    some = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    passage = some(64)
    two = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([some(50), passage, passage + some(9), some(60), some(9) + passage[:50]], 7)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in chain_dedup.fuzzy_repeats(two).collect()} == {7: 7, 8: 8, 9: 8, 10: 10, 11: 8}
    for copies in (1, 5):  # with five, the short seeds have more documents than owners
        slices = [passage[a:b] for a, b in ((0, 20), (14, 36), (30, 50), (46, 64)) for _ in range(copies)]
        texts = [some(30) + x + some(30) for x in slices] + [some(25) + passage + some(35), some(40) + passage + some(10)]
        n = len(texts)
        found = chain_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))[1].collect()
        assert [(r.doc_id, r.source, r.start, r.end, r.common) for r in found] == [(n - 1, n - 2, 40, 104, 64)]


@pytest.mark.parametrize("copies,each", [(6, 12), (60, 4)])
def test_verbatim_passages_whose_slices_are_common(spark, copies, each):
    """Two documents share 40 to 60 words in a row, of which every slice of 20 words stands in 6 or 60 earlier documents."""
    rng = np.random.default_rng(39)
    some = lambda n: ["".join(x) for x in rng.choice(list("abcdefgh"), (n, 6))]
    slices, pairs, want = [], [], {}
    for length in (40, 41, 45, 50, 60):
        for _ in range(each):
            passage = some(length)
            slices += [some(15) + passage[a : a + 24] + some(15) for a in range(0, length - 19, 5) for _ in range(copies)]
            pairs += [some(25) + passage + some(35), some(40) + passage + some(10)]
    texts = slices + pairs
    for i in range(len(slices) + 1, len(texts), 2):
        want[i] = (i - 1, 40, 40 + len(pairs[i - len(slices)]) - 50)
    found = chain_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))[1].collect()
    got = {r.doc_id: (r.source, r.start, r.end) for r in found}
    assert len(found) == len(got) and got == want


def test_recall_on_mosaics_against_all_pairs(spark):
    """Documents made of pieces that others have too: each word in a passage that brute force finds in an earlier document."""
    rng = np.random.default_rng(37)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    pieces = [[word() for _ in range(int(rng.integers(10, 80)))] for _ in range(40)]
    texts = []
    for _ in range(70):
        own = []
        for _ in range(4):
            p = pieces[rng.integers(len(pieces))]
            p = p[int(rng.integers(max(1, len(p) - 30))) :]
            own += edited(rng, p, (0, 0, 0.1)[rng.integers(3)], word) + [word() for _ in range(int(rng.integers(0, 60)))]
        texts.append(own)
    got = {r.doc_id: r for r in chain_dedup.fuzzy_repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    ids: dict = {}
    arrays = [np.array([ids.setdefault(w, len(ids)) for w in t], np.uint32) for t in texts]
    truth = found = extra = 0
    for d, mine in enumerate(arrays):
        covered = np.zeros(len(mine), bool)
        for other in arrays[:d]:
            at: dict = {}
            for j in range(len(other) - 4):
                at.setdefault(tuple(other[j : j + 5]), []).append(j)
            matches = sorted((i, j) for i in range(len(mine) - 4) for j in at.get(tuple(mine[i : i + 5]), ()))
            for chain in chain_dedup.chains([i for i, _ in matches], [j for _, j in matches]) if len(matches) > 1 else ():
                x, y, n = chain_dedup.runs(*(np.array([matches[c][k] for c in chain]) for k in (0, 1)))
                for a, b, *_ in chain_dedup.found_in([(mine, other, x, y, n)])[0]:
                    covered[a:b] = True
        truth += covered.sum()
        found += min(covered.sum(), got[d].n_dup_words)
        extra += max(0, got[d].n_dup_words - covered.sum())
    print("mosaics", found / truth, extra / truth)
    assert found >= 0.9 * truth and extra <= 0.02 * truth


def test_rows_of_one_id_are_told_apart(spark):
    rng = np.random.default_rng(38)
    some = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    passage, clean = some(60), some(300)
    leak = some(20) + passage
    rows = [(1, " ".join(passage + some(10))), (2, " ".join(leak)), (2, " ".join(clean)), (None, " ".join(some(30) + passage[:50])), (None, " ".join(some(70))), (2, " ".join(leak)), (3, " ".join(leak)), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key2", "2 as k0", "'x' as words", "3 as leader", "4L as chunk", "5 as source")
    classes = {(r.doc_id, r.n_words): r.class_id for r in chain_dedup.fuzzy_repeats(df).collect()}
    assert classes == {(None, 80): None, (None, 70): None, (1, 70): None, (2, 80): None, (2, 300): 2, (3, 80): None, (4, 0): 4, (5, 0): 5}
    got = sorted(((r.doc_id, r.n_words, r.n_dup_words, tuple(r.sources), r.n_linked) for r in chain_dedup.fuzzy_repeats(df).collect()), key=repr)
    # the null document comes first; 1 has 50 words of it, 2 and its copies 60 of 1
    assert got == sorted([(None, 80, 0, (), 2), (None, 70, 0, (), 0), (1, 70, 50, (None,), 1), (2, 80, 60, (None, 1), 1), (2, 80, 60, (None, 1), 1), (2, 300, 0, (), 0), (3, 80, 80, (2,), 0), (4, 0, 0, (), 0), (5, 0, 0, (), 0)], key=repr)
    assert chain_dedup.fuzzy_repeats(df.limit(0)).collect() == []


def test_fenwick_chains_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(2, 14))
        pos, other = sorted(rng.integers(0, 60, n).tolist()), rng.integers(0, 60, n).tolist()
        best = [float(chain_dedup.K)] * n
        for i in range(n):
            for j in range(n):
                if pos[j] < pos[i] and other[j] < other[i]:
                    best[i] = max(best[i], chain_dedup.K + best[j] - chain_dedup.GAP * (pos[i] - pos[j] + other[i] - other[j]))
        got = chain_dedup.chains(pos, other)
        for c in got:
            assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:]))
        if got:
            c = got[0]
            value = chain_dedup.K * len(c) - chain_dedup.GAP * (pos[c[-1]] - pos[c[0]] + other[c[-1]] - other[c[0]])
            assert value == pytest.approx(max(best))


def signs(rng, n, script):
    first, last = {"han": (0x4E00, 0x9FA5), "kana": (0x3041, 0x3096), "thai": (0x0E01, 0x0E2E), "rare": (0x20000, 0x2A6DF)}[script]
    return [chr(x) for x in rng.integers(first, last + 1, n)]


def spoken(run, mark="\u3002"):
    """A run of signs with a mark after every 17."""
    return mark.join("".join(run[i : i + 17]) for i in range(0, len(run), 17))


@pytest.mark.parametrize("text", ["ab\u4e00\u4e01cd \u3042\u3001\u3044", "\u0e01\u0e32\u0e23", "\U00020000x\U00020001", "don\u2019t \u201cgo\u201d na\u00efve \u043c\u0438\u0440", "\uff21\uff22\uff01\uff23", "\ud55c\uad6d\uc5b4 \ub9d0", "", "\u3002", "\u4e00"])
def test_words_of_any_script(text):
    class_of = lambda ranges: "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"
    want = [w for run in re.split(rf"\s+|{class_of(common.MARKS)}", text) for w in re.findall(rf"{class_of(common.SIGNS)}|(?:(?!{class_of(common.SIGNS)}).)+", run)]
    data = np.frombuffer((text + "zz" + text).encode(), np.uint8)
    n = len(text.encode())
    w = common.Words(data, np.array([0, n, n + 2, 2 * n + 2]), signs=True)
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert got == [*want, "zz", *want] and w.count.tolist() == [len(want), 1, len(want)]


@pytest.mark.parametrize("script", ["han", "kana", "thai", "rare"])
def test_leaks_without_spaces(spark, script):
    rng = np.random.default_rng(12)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200).select("doc_id", "text")
    item = signs(rng, 60, script)
    changed = [x if i % 5 else y for i, (x, y) in enumerate(zip(item, signs(rng, 60, script)))]
    around = lambda: spoken(signs(rng, 150, script))
    planted = [(10**6, around() + "".join(item) + around()), (10**6 + 1, around() + "\u3002" + spoken(item) + "\u3002" + around()), (10**6 + 2, "in English " + "".join(changed) + " too"), (10**6 + 3, around() + around()), (10**6 + 4, None)]
    items = spark.createDataFrame([(1, "".join(item)), (2, None)], "item_id long, text string")
    got = {r.doc_id for r in decontam.contaminated(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string")), items).collect()}
    assert got == {10**6, 10**6 + 1, 10**6 + 2}


@pytest.mark.parametrize("script", ["han", "thai"])
def test_passages_without_spaces(spark, script):
    rng = np.random.default_rng(13)
    shared = signs(rng, 200, script)
    changed = [x if (i + 1) % 15 else y for i, (x, y) in enumerate(zip(shared, signs(rng, 200, script)))]
    around = lambda: spoken(signs(rng, 120, script))
    rows = [(1, around() + spoken(shared) + around()), (2, around() + "".join(shared)), (3, "Quoted: " + "".join(changed) + around()), (4, around() + around())]
    found = chain_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()
    assert {(r.doc_id, r.source) for r in found} >= {(2, 1), (3, 1)} and {r.doc_id for r in found} == {2, 3}
    assert all(r.common >= 180 for r in found if r.source == 1)


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    texts = docs.select("doc_id", "text").collect()
    truth = {(r.doc_id, i.item_id) for i in items.collect() for r in texts if i.text in r.text}
    assert truth <= got and len(got - truth) <= 0.05 * len(got)
    kept = decontam.clean_documents(docs, items)
    assert kept.count() == len(texts) - len({d for d, _ in got}) and kept.columns == docs.columns


def test_paraphrase(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    item = max(items.collect(), key=lambda r: len(r.text))
    words = item.text.split()
    words[2], words[9] = "other", "change"
    del words[5]
    planted = docs.limit(400).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "before it some words " * 8 + " ".join(words) + " and more after it" * 9)], "doc_id long, text string"))
    assert (10**6, item.item_id) in {(r.doc_id, r.item_id) for r in decontam.contaminated(planted, items).collect()}


@pytest.mark.parametrize(("a", "b", "n"), [("abcbdab", "bdcaba", 4), ("", "x", 0), ("abc", "abc", 3)])
def test_lcs(a, b, n):
    masks: dict = {}
    for j, t in enumerate(b):
        masks[ord(t)] = masks.get(ord(t), 0) | 1 << j
    assert decontam.lcs([ord(t) for t in a], masks, len(b)) == n
    assert chain_dedup.common([ord(t) for t in a], [ord(t) for t in b]) == n


@pytest.mark.parametrize("kept,least", [(0.65, 1), (0.75, 1), (0.85, 1)])
def test_recall_of_paraphrases(spark, kept, least):
    rng = np.random.default_rng(45)
    vocabulary = np.array(sorted({w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect() for w in words_of(r.text)}))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, truth = [], set()
    for k, item in enumerate(items.collect() * 3):
        own = words_of(item.text)
        words = list(own)
        for i in rng.choice(len(words), int((1 - kept) * len(words)), replace=False).tolist():
            words[i] = str(rng.choice(vocabulary))
        before = rng.choice(vocabulary, rng.integers(20, 60)).tolist()
        rows.append((10**6 + k, " ".join(before + words + rng.choice(vocabulary, 40).tolist())))
        tail = own[len(own) - max(3, -(-len(own) // 4)) :]
        common, answer = chain_dedup.common(words, own), chain_dedup.common(words, tail)
        if common >= decontam.LCS_SURE * len(own) or (common >= decontam.LCS_LIKELY * len(own) and answer >= decontam.ANSWER * len(tail)):
            truth.add((10**6 + k, item.item_id))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    print("recall", kept, len(got & truth) / len(truth), "of", len(truth))
    assert len(got & truth) >= least * len(truth)


@pytest.mark.parametrize("n", [70, 112, 200, 500, 1500])
def test_long_items(spark, n):
    rng = np.random.default_rng(n)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    item = some(n)
    texts = [some(150) for _ in range(40)] + [some(75) + " " + item + " " + some(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.lcs, r.item_words) for r in found] == [(40, n, n)]


def test_decontamination_of_odd_rows(spark, documents, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same text here as well as there same text here as well as there")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(documents, items).collect()} <= {900006, 900007, None}
    assert decontam.contaminated(none, items).count() == decontam.contaminated(documents, items.limit(0)).count() == 0
    assert decontam.clean_documents(documents, items.limit(0)).count() == documents.count()


def test_clean_rows_of_shared_ids_stay(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = max((r.text for r in items.collect()), key=len)
    rows = [(None, "before it " + item + " after it"), (None, "a clean text of its own " * 6), (5, "some words " + item), (5, "another clean text " * 7), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as __w", "2 as __leak", "3 as __wleak", "4 as __h", "5 as __k")
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept.collect()) == [(0, "a clean"), (5, "another"), (6, "")]


def test_filters_hand_on_columns_of_any_name(spark, small):
    """Working columns never clash with given ones, and keep their values."""
    from pagemill.llm import quality, simhash

    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", *[f"doc_id * {i} as {c}" for i, c in enumerate(("__w", "__wk", "__h", "__k", "__n", "__m", "__c", "__i", "__id", "key", "copies"))])
    for stage in (quality.quality_filter, simhash.keep_one, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        assert out.where("__wk <> doc_id or __i <> 7 * doc_id or copies <> 10 * doc_id").count() == 0 < out.count()
        assert stage(docs.limit(0)).count() == 0


def test_language_id(spark, documents, none):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(train)
    got = langid.identify(train, model).join(train.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    assert odd[900001].lang_pred == odd[900002].lang_pred == odd[900005].lang_pred == "und" and odd[900001].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identify(none, model).count() == 0 and langid.fit(none) is None
    assert {r.lang_pred for r in langid.identify(documents, None).collect()} == {"und"}
    # the temperature is inside its grid, and the threshold cuts off some slices but no great part of them
    assert 1 / 64 < model.temperature < 64 and 0.3 < model.threshold < 1 - 1e-6 and 0.5 < model.coverage < 1
    whole = [r for r in got if len(r.lang) and r.score >= model.threshold]
    assert len(whole) >= 0.97 * len(got)
    right = [r for r in got if not r.rejected]
    assert np.mean([r.lang_pred == r.lang for r in right]) >= np.mean([r.lang_pred == r.lang for r in got])


@pytest.mark.parametrize("long", [6000, 40000])
def test_long_texts_do_not_push_out_a_language(spark, monkeypatch, long):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 5000)
    rows = [(i, lang, " ".join([words] * 2)) for i, (lang, words) in enumerate([("en", "the cat sat on the mat"), ("de", "der hund liegt auf dem bett")] * 60)]
    rows += [(1000 + i, "en", ("the house and the garden " * long)[:long]) for i in range(30)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string")).languages == ["de", "en"]
    giants = [(i, "en", ("the house and the garden é" * long)[:long]) for i in range(9)] + [(i, "de", "der hund liegt auf dem bett") for i in range(20, 90)]
    assert langid.fit(spark.createDataFrame(giants, "doc_id long, lang string, text string")).languages == ["de", "en"]


def test_language_scores_are_calibrated(spark):
    """Scores of slices that training has not seen: about as many are right as they say, and the accepted ones are right."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rng = np.random.default_rng(17)
    rows = []
    for r in docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 and lang is not null").collect():
        words = r.text.split()
        for n in (1, 2, 3, 6, 12):
            if len(words) > n:
                at = int(rng.integers(len(words) - n))
                rows.append((len(rows), r.lang, " ".join(words[at : at + n])))
    truth = {i: x for i, x, _ in rows}
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).where("lang_pred <> 'und'").collect()
    right = np.array([r.lang_pred == truth[r.doc_id] for r in got])
    score = np.array([r.score for r in got])
    accepted = np.array([not r.rejected for r in got])
    print("slices", right.mean(), "mean score", score.mean(), "accepted", accepted.mean(), right[accepted].mean(), model.temperature, model.growth, model.threshold, model.coverage)
    assert abs(right.mean() - score.mean()) < 0.05 and right[accepted].mean() >= 0.97 and accepted.mean() > 0.5


def test_pages_of_the_template(spark, small):
    for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        body = re.sub(r"<[a-zA-Z/][^>]*\Z", "", body)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<html><head><title>t</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this site the best of all that there is on the net</p></div>
<main><h1>Title &amp; more</h1><p>The  first\n paragraph of the text is here, and it is long enough to be one of the good ones.<p>Short one.</p>
<aside><p>See also the other pages that we have on this site for you and for all of the others</p></aside><p>1 &lt; 2 and so&nbsp;on<!-- hidden <p>no</p> --></p>
<form><p>Give us your name</p><input></form><div id="comments"><p>I was the first to say that this is the best of all the texts on the web</p></div></main>
<div class="ad">Buy the best of all</div><footer>&copy; us</footer></body></html>"""


def test_page_by_hand():
    assert html_extract.main_text(PAGE).split("\n\n") == ["Title & more", "The first paragraph of the text is here, and it is long enough to be one of the good ones.", "Short one.", "1 < 2 and so on"]


def test_page_without_article():
    text = "It was the best of times and it was the worst of times, and all of them were there to see what would come of it in the end. " * 3
    page = f"<body><div><a href=x>Menu</a> <a href=y>More</a></div><p>{text}</p><p>Short in the middle.</p><p>{text}</p><div><a href=z>Next</a></div></body>"
    assert html_extract.main_text(page).count("\n\n") == 2 and "Menu" not in html_extract.main_text(page)


ENGLISH = "It was the best of times and it was the worst of times, and all of them were there to see what would come of it in the end. " * 3
PROSE = {
    "en": ENGLISH,
    "it": "La mattina il sole entrava dalla finestra e la casa era piena di luce. Nessuno parlava, ma tutti sapevano che il giorno sarebbe stato lungo e che la sera non avrebbe portato riposo. Il vecchio guardava il mare.",
    "ru": "Утром над рекой стоял густой туман, и лодки у берега казались серыми тенями. Старик вышел из дома, посмотрел на небо и медленно пошёл к воде, где его ждали рыбаки. Никто не говорил ни слова, только тихо плескались волны.",
    "pl": "Rano nad rzeką unosiła się gęsta mgła, a łodzie przy brzegu wyglądały jak szare cienie. Starzec wyszedł z domu, spojrzał na niebo i powoli ruszył w stronę wody, gdzie czekali na niego rybacy. Nikt nie powiedział ani słowa.",
    "fi": "Aamulla joen yllä leijui sakea sumu, ja rannan veneet näyttivät harmailta varjoilta. Vanhus astui ulos talostaan, katsoi taivaalle ja lähti hitaasti kohti vettä, missä kalastajat odottivat häntä. Kukaan ei sanonut sanaakaan.",
    "zh": "清晨的河面上笼罩着浓雾，岸边的小船看上去像灰色的影子。老人走出家门，抬头看了看天空，然后慢慢地向水边走去，渔夫们正在那里等他。没有人说话，只有波浪轻轻地拍打着岸边，远处传来几声鸟叫。",
    "ja": "朝の川には濃い霧が立ちこめ、岸辺の舟は灰色の影のように見えた。老人は家を出て空を見上げ、漁師たちの待つ水辺へゆっくりと歩いていった。誰も口をきかず、波の音だけが静かに響いていた。遠くで鳥が鳴いた。",
}


def page_of(text, name="content"):
    menu = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(6))
    return f'<body><div class="menu"><ul>{menu}</ul></div><div class="{name}"><p>{text}</p><p>{text}</p></div><div><a href=z>Next page</a> <a href=y>Contact</a></div></body>'


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_any_language_without_article(lang):
    text = PROSE[lang].strip()
    assert html_extract.main_text(page_of(text)) == f"{text}\n\n{text}"


@pytest.mark.parametrize("name", ["social-science", "ad-free", "widget-area", "related-work", "article-notice", "search-results-article", "content has-sidebar", "shareholders"])
def test_innocent_class_names(name):
    text = ENGLISH.strip()
    assert html_extract.main_text(page_of(text, name)) == f"{text}\n\n{text}"


@pytest.mark.parametrize("name", ["ad", "comments", "comment-body", "cookie-notice", "site-footer", "sidebar right", "newsletterSignup", "google_ad_slot", "main-nav"])
def test_marked_parts_go(name):
    page = page_of(ENGLISH).replace("</body>", f'<div class="{name}"><div><p>{"This is what the marked part of the page has to say to all of its readers. " * 4}</p></div></div></body>')
    assert html_extract.main_text(page) == "\n\n".join([ENGLISH.strip()] * 2)


@pytest.mark.parametrize("name", ["cookie-recipe", "comments-on-the-budget", "newsletter-history", "navigation-systems", "consent-law", "footer-notes", "subscription-economics", "login-security-article", "cookie-policy-analysis"])
def test_articles_about_marking_words(name):
    text = ENGLISH.strip()
    assert html_extract.main_text(page_of(text, name)) == f"{text}\n\n{text}"
    # beside an article such a part is none
    page = page_of(ENGLISH).replace("</body>", f'<div class="{name}"><p>{"This is what the marked part of the page has to say to all of its readers. " * 4}</p></div></body>')
    assert html_extract.main_text(page) == f"{text}\n\n{text}"


@pytest.mark.parametrize("name", ["post-comments", "user-comments", "comment-list", "commentThread", "comment-text", "cookie-banner", "footer-links", "site-footer-copyright", "ad-300x250", "newsletter-box"])
def test_last_word_says_what_a_part_is(name):
    page = f'<body><div class="{name}"><p>{ENGLISH}</p><p>{ENGLISH}</p></div><div class="story"><p>{ENGLISH}</p></div></body>'
    assert html_extract.main_text(page) == ENGLISH.strip()


SHORTS = {
    "dialogue": ["\u201cWho is there?\u201d", "\u201cOnly me, as ever.\u201d", "\u201cYou are late.\u201d", "\u201cThe road was long.\u201d", "\u201cIt always is.\u201d", "\u201cMay I come in?\u201d", "\u201cIf you must.\u201d", "She did."],
    "two": ["The shop is closed on Monday.", "It opens again on Tuesday at nine in the morning."],
    "fi": ["Vanhus astui ulos talostaan ja lähti hitaasti kohti rantaa odottamaan kalastajia.", "Aamulla joen yllä leijui sakea sumu, ja rannan veneet näyttivät harmailta varjoilta."],
    "tr": ["Sabahleyin nehrin üzerinde yoğun bir sis vardı ve kıyıdaki kayıklar gri gölgeler gibi görünüyordu.", "Yaşlı adam evinden çıktı, gökyüzüne baktı ve yavaşça suya doğru yürümeye başladı."],
}


@pytest.mark.parametrize("kind", sorted(SHORTS))
def test_pages_of_short_paragraphs(kind):
    menu = "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(6))
    page = f"<body><nav><ul>{menu}</ul></nav><h1>Title</h1><div>{''.join(f'<p>{x}</p>' for x in SHORTS[kind])}</div><footer><p>All rights reserved. Do not copy.</p></footer></body>"
    assert html_extract.main_text(page).split("\n\n")[-len(SHORTS[kind]) :] == SHORTS[kind]
    assert "Part" not in html_extract.main_text(page) and "rights" not in html_extract.main_text(page)


def test_page_of_parts_only():
    menu = "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(6))
    assert html_extract.main_text(f"<body><nav>{menu}</nav><p>Ok.</p><form>Your name and your password, please, all of you.</form><footer>All rights reserved.</footer></body>") == ""


def test_parts_inside_marked_parts():
    page = f'<div class="related-work"><p>{ENGLISH}</p><div class="ad"><p>{ENGLISH} Buy.</p></div><p>{ENGLISH}</p></div><p>{ENGLISH}</p>'
    assert html_extract.main_text(page) == "\n\n".join([ENGLISH.strip()] * 3)


def test_mathematics_stays():
    page = f"<article><p>{ENGLISH} We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>"
    assert html_extract.main_text(page).endswith("We have x=2 here.")


def test_pages_of_any_table(spark):
    df = spark.createDataFrame([(1, None, page_of(ENGLISH)), (1, "u", page_of(ENGLISH)), (None, "u", None), (2, "u", "")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as doc_id")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    long = 2 * len(ENGLISH.strip()) + 2
    assert sorted(((r.page_id or 0, r.url, r.n_chars) for r in got.collect()), key=repr) == sorted([(1, None, long), (1, "u", long), (0, "u", 0), (2, "u", 0)], key=repr)
    assert html_extract.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", [None, "", "<", "<p", "a &am", "<!-- open", "<script>x", "</p></div>", "<p>" * 3000, "<article>" * 50 + "x"])
def test_broken_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_pipeline_stages(spark, documents):
    """Every stage's decision against the operator that makes it, on the smallest tables with odd rows."""
    from pagemill.llm import quality, simhash
    from pagemill.llm.common import saved

    sf = "/root/testdata/sf0.001"
    docs = documents
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf))
        before, after = Counter(r.doc_id for r in docs.select("doc_id").collect()), Counter(r.doc_id for r in out.select("doc_id").collect())
        seen[name] = (before, after)
        if name == "quality":
            assert after == Counter(r.doc_id for r in quality.judged(docs).collect() if r.kept)
        if name == "near_dedup":
            assert len(after) == after.total() == len({r.component_id for r in simhash.near_duplicates(docs).collect()})
        if name == "decontaminate":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            every = docs.select("doc_id", "text").collect()
            numbered = spark.createDataFrame([(i, r.text) for i, r in enumerate(every)], "doc_id long, text string")
            leaks = {r.doc_id for r in decontam.contaminated(numbered, items).collect()}
            assert after == Counter(r.doc_id for i, r in enumerate(every) if i not in leaks)
        if name == "mix":
            assert set(after) <= set(before) and after.total() > before.total()
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
        else:
            assert after == before
            starts = sorted((r.start, r.n_tokens) for r in out.collect())
            assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_pipeline_of_nothing(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


@pytest.mark.parametrize("length", [40, 45, 60])
def test_verbatim_runs_whose_long_seeds_others_have(spark, length):
    """Every run of 34 words of a passage stands in six earlier documents, or its first 36 words stand in its owner before it; the passage is found where it stands."""
    rng = np.random.default_rng(40)
    some = lambda n: ["".join(x) for x in rng.choice(list("abcdefgh"), (n, 6))]
    passage = some(length)
    slices = [some(50) + passage[a : a + 34] + some(50) for a in range(length - 33) for _ in range(6)]
    again = some(length)
    texts = slices + [some(25) + passage + some(35), some(40) + passage + some(10), some(20) + again[:36] + some(80) + again + some(30), some(70) + again + some(70)]
    n = len(texts)
    found = chain_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))[1].collect()
    got = {(r.doc_id, r.source, r.start, r.end, r.source_start) for r in found if r.doc_id >= n - 4 and r.source >= n - 4}
    assert got == {(n - 3, n - 4, 40, 40 + length, 25), (n - 1, n - 2, 70, 70 + length, 136)}


def test_places_of_one_run_inside_a_found_passage_are_not_tested_again():
    """A sentence that a document repeats on and on: all its words are covered, by few passages."""
    rng = np.random.default_rng(41)
    own = np.concatenate([rng.integers(100, 200, 70), np.full(2000, 7), rng.integers(100, 200, 70)]).astype(np.uint32)
    other = np.concatenate([rng.integers(200, 300, 64), np.full(60, 7), rng.integers(200, 300, 40)]).astype(np.uint32)
    found = chain_dedup.found_at([(own, other, np.arange(70, 2041), np.array([64]), np.array([chain_dedup.LONG]))])[0]
    covered = np.zeros(len(own), bool)
    for a, b, *_ in found:
        covered[a:b] = True
    assert covered[70:2070].all() and not covered[:60].any() and not covered[2080:].any() and len(found) < 100


def _covered(found, n):
    out = np.zeros(n, bool)
    for a, b, *_ in found:
        out[a:b] = True
    return out


def test_words_repeated_on_and_on_are_few_passages(spark):
    """Documents that go on with two words of an earlier one: all their words are covered, by passages that grow with the words, not with the places."""
    rng = np.random.default_rng(42)
    some = lambda n: ["".join(x) for x in rng.choice(list("abcdefgh"), (n, 6))]
    texts = [some(80) + ["red", "blue"] * 35 + some(60)] + [some(70) + ["red", "blue"] * 300 + some(70) for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = chain_dedup.passages(docs)[1].collect()
    for i in range(1, 7):
        own = [(r.start, r.end) for r in found if r.doc_id == i and r.source == 0]
        assert len(own) < 30
        covered = _covered(own, 740)
        assert covered[70:670].all() and not covered[:60].any() and not covered[680:].any()


def test_places_of_a_chain_are_all_tested_and_the_fewest_passages_stay():
    rng = np.random.default_rng(43)
    for _ in range(20):
        other = np.concatenate([rng.integers(200, 300, 64), np.tile([7, 8], 35), rng.integers(200, 300, 64)]).astype(np.uint32)
        own = np.concatenate([rng.integers(100, 200, 70), np.tile([7, 8], 200), rng.integers(100, 200, 70)]).astype(np.uint32)
        own[rng.integers(70, 470, 30)] = 9
        places = np.array([p for p in range(70, 464) if own[p] == 7 and np.array_equal(own[p : p + 6], other[64:70])])
        n = np.array([6])
        each = [x for p in places for x in chain_dedup.found_at([(own[max(0, p - 64) : p + 70], other, np.array([min(p, 64)]), n * 0 + 64, n)])[0] for x in [(x[0] + max(0, p - 64), x[1] + max(0, p - 64), *x[2:])]]
        got = chain_dedup.found_at([(own, other, places, n * 0 + 64, np.full(len(places), 6))])[0]
        assert set(got) <= set(each) and (_covered(got, len(own)) == _covered(each, len(own))).all()
        # each word is in two of them at most
        assert all(a[1] <= c[0] for a, c in zip(got, got[2:]))
