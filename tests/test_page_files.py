"""Page files: groups of files as partitions, pages streamed, broken files as events."""

import gzip

import pytest

from pagemill.sources import page_files


@pytest.fixture
def folder(tmp_path):
    for name, pages in {"law/a.txt": ["one", "two\nlines", ""], "law/b.txt": ["ü" * 700_000, "x"], "sport/c.txt": ["only"], "sport/deep/d.txt": ["p", "q"]}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\f".join(pages), encoding="utf-8")
    (tmp_path / "sport/bad.txt").write_bytes(b"fine\f\xff\xfe\fnever")
    (tmp_path / "sport/none.txt").write_bytes(b"")
    (tmp_path / "sport/other.csv").write_text("no")
    return str(tmp_path)


WANT = [("a.txt", "law", 1, "one"), ("a.txt", "law", 2, "two\nlines"), ("a.txt", "law", 3, ""), ("b.txt", "law", 1, "ü" * 700_000), ("b.txt", "law", 2, "x"), ("bad.txt", "sport", 1, "fine"), ("c.txt", "sport", 1, "only"), ("d.txt", "deep", 1, "p"), ("d.txt", "deep", 2, "q"), ("none.txt", "sport", 1, "")]


@pytest.mark.parametrize("spark_only", [False, True])
def test_pages_and_events(spark, folder, monkeypatch, spark_only):
    if spark_only:
        monkeypatch.setattr(page_files, "local_path", lambda path: None)
    pages, events = page_files.without_events(page_files.read_pages(spark, folder, pattern="*.txt", group_bytes=1000))
    assert sorted(tuple(r) for r in pages.select("doc_id", "domain", "page_num", "text").collect()) == [r for r in WANT if not spark_only or r[0] != "none.txt"]
    (event,) = events.collect()
    assert event.path.endswith("sport/bad.txt") and event.error.startswith("UnicodeDecodeError")


def test_groups(folder):
    sizes = lambda n: [len(g) for g in page_files.groups(folder, "*.txt", n)]
    assert sizes(1 << 30) == [6] and sizes(1) == [1] * 5 + [1] and sum(sizes(20)) == 6
    assert page_files.groups(folder, "*.pdf", 10) == []


def test_a_group_is_a_partition(spark, folder):
    assert page_files.read_pages(spark, folder, pattern="*.txt", group_bytes=1).rdd.getNumPartitions() == 6
    assert page_files.read_pages(spark, folder, pattern="*.txt").rdd.getNumPartitions() == 1
    assert page_files.read_pages(spark, folder, pattern="*.none").collect() == []


def test_a_parser_streams(tmp_path):
    """What is read of a file is what the pages taken so far need."""
    (tmp_path / "long").write_bytes(b"\f".join(b"%d" % i * 1000 for i in range(2000)))
    with open(tmp_path / "long", "rb") as f:
        pages = page_files.form_feed_pages(f, 1 << 16)
        assert next(pages) == "0" * 1000 and f.tell() == 1 << 16
        assert sum(1 for _ in pages) == 1999


def test_batches_are_bounded(monkeypatch):
    rows = [("p", "d", "x", i, "y" * 1000, None) for i in range(2500)]
    assert [b.num_rows for b in page_files.batches(rows)] == [1000, 1000, 500]
    monkeypatch.setattr(page_files, "BATCH_BYTES", 12_000)
    assert {b.num_rows for b in page_files.batches(rows)} == {10}


def unzipped(file):
    yield from page_files.form_feed_pages(gzip.GzipFile(fileobj=file))


def test_own_format(spark, tmp_path):
    """A registered format with a parser of one's own, and its options."""
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"first\fsecond"))
    (tmp_path / "y.gz").write_bytes(b"not compressed")
    spark.dataSource.register(page_files.page_source("zipped_pages", unzipped))
    rows = spark.read.format("zipped_pages").option("pattern", "*.gz").load(str(tmp_path)).collect()
    assert [(r.page_num, r.text) for r in rows if r.doc_id == "z.gz"] == [(1, "first"), (2, "second")]
    assert [r.error.split(":")[0] for r in rows if r.doc_id == "y.gz"] == ["BadGzipFile"]
