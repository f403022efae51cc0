"""Text functions against hand-worked values and plain restatements."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import retrieve


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_answer(spark):
    cases = {"B.": "B", "  c) x": "C", "Д": "D", "": "A", "xyz": "A", "ok, choice": "C", "Відповідь: C": "B", "Правильно: (E)": "E", "Because": "B"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", tx.answer("t").alias("got")).collect()
    assert [(r.t, r.got) for r in rows if r.got != r.want] == []


def test_bleed(spark):
    pages = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc"), (2, 1, "x")], "doc_id int, page_num int, text string")
    got = [r.bled for r in retrieve.neighbor_bleed(pages, 2).orderBy("doc_id", "page_num").collect()]
    assert got == ["aaaabb", "aabbbbcc", "bbcccc", "x"]


def test_segments(spark):
    assert [s.start for s in one(spark, tx.segments("t", 900, 512), t="x" * 1500)] == [0, 512]
    assert [s.start for s in one(spark, tx.segments("t", 900, 512), t="x" * 300)] == [0]
    assert [s.segment for s in one(spark, tx.segments("t", 3, 2), t="     ")] == ["   "]


def plain_chunks(page, text, chunk, overlap, heading_chars, least):
    """A restatement of the fold over lines, as a state machine of its own."""
    out, held, size, title = [], [], 0, None

    def heading(line):
        letters = [c for c in line if c.isalpha()]
        return bool(letters) and len(line) <= heading_chars and (sum(c.isupper() for c in letters) >= 0.6 * len(letters) or line[-1] == ":" or line[0].isdigit())

    def close():
        nonlocal held, size, title
        if held:
            body = "\n".join(held).strip()
            head = f"[Сторінка {page}]" + (f" {title}" if title and title not in body else "")
            out.append(f"{head}\n{body}"[: chunk + 64])
            rest = body[-overlap:].strip() if overlap else ""
            held, size, title = [rest] if rest else [], len(rest), None

    for line in filter(None, (x.strip() for x in text.splitlines())):
        if heading(line) and size >= least:
            close()
            title = line
            continue
        held.append(line)
        size += len(line) + 1
        title = line if title is None and heading(line) else title
        if size >= chunk:
            close()
    close()
    return out or [f"[Сторінка {page}]\n{text[:chunk]}"]


def test_structure_chunks_by_hand(spark):
    got = one(spark, tx.structure_chunks("t", F.lit(1), 20, 5, 120, 10), t="alpha beta\ngamma delta")
    assert got == ["[Сторінка 1]\nalpha beta\ngamma delta", "[Сторінка 1]\ndelta"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcAB1: \n", max_size=40), min_size=1, max_size=10))
def test_structure_chunks(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", tx.structure_chunks("t", F.lit(3), 30, 7, 20, 12).alias("c")).collect()
    assert [(r.t, r.c) for r in rows if r.c != plain_chunks(3, r.t, 30, 7, 20, 12)] == []


def test_structure_chunks_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", tx.structure_chunks("text", F.lit(1)).alias("c")).collect()
    assert [r.text[:40] for r in docs if r.c != plain_chunks(1, r.text, 700, 120, 120, 180)] == []


def test_nulls_do_not_crash(spark):
    df = spark.createDataFrame([(None, 1)], "t string, n int")
    df.select(tx.tokens("t"), tx.strip("t"), tx.lines("t"), tx.segments("t", 5, 2), tx.page_summary("t", "n"), tx.answer("t"), tx.int_or("t")).collect()
