import pytest

#: Rows that are in no way ordinary: nulls, empty, no words, ties, repeats, long, no end of line, unusual white space.
ODD = [
    (None, "an id that is missing, and enough words to be a text of its own", "en", "s1"), (900001, None, "en", "s1"), (900002, "", None, None), (900003, " \t\n ", "en", None), (900004, "a", "fr", "s2"), (900005, "123 456 !!", "fr", "s2"),
    (900006, "same text here as well as there " * 9, "en", "s1"), (900007, "same text here as well as there " * 9, "en", "s1"), (900007, "same text here as well as there " * 9, "en", "s1"),
    (900008, "naïve café x \U0001f600 Жж <|endoftext|> <|ENDOFTEXT|> don't I'LL ÉCOLE. ßſ fiﬁ é…, x×, 9,", "de", "s3"), (900009, "word " * 30000 + "end", "es", "s1"), (900010, "x" * 70000, "es", "s1"),
]


@pytest.fixture(scope="session")
def documents(spark, small):
    """The smallest documents table with odd rows, columns in another order and extra columns with awkward names."""
    odd = spark.createDataFrame([(t, s, i, lang) for i, t, lang, s in ODD], "text string, source string, doc_id long, lang string")
    every = spark.read.parquet(f"{small}/documents.parquet").select("text", "source", "doc_id", "lang").unionByName(odd)
    return every.selectExpr("*", "length(text) as n_chars", "1 as chunk", "'x' as word", "2L as size", "3 as key", "4 as fp", "'y' as data", "5 as bucket").repartition(5).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return documents.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="session")
def none(documents):
    return documents.limit(0)
