import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, doc string, at long")
        return df.repartition(parts)

    return make


#: Rows that every operator must take: nulls, empty, long, ties, repeats.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id at all"), (None, None), (5, "é" * 50_000), (6, "a b " * 30_000), (7, "9" * 20_000), (8, "!?" * 1000), (9, "same text here"), (10, "same text here"), (11, "nul\0byte and ▁ mark"), (12, "line\n" * 5_000)]
