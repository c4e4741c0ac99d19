import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, white, short, very long, repeated and tied texts, beside columns whose names clash with results."""
    long_text = " ".join(f"word{i % 977} rest{i}" for i in range(30_000))
    line = "A line that is long enough to be counted as shared by many"
    rows = [
        (0, None), (1, ""), (2, " \t\n\r "), (3, "one"), (4, "Two words"), (5, long_text), (6, long_text + " end"), (7, f"a\n{line}\nb"), (8, f" {line.upper()} \nc"),
        (9, f"{line}\t\n{line}"), (10, line), (11, line), (11, line), (12, "naïve café — 漢字  x <|endoftext|> don't 3.14"), (13, "\x00 \x1c odd"), (14, long_text),
    ]
    frame = spark.createDataFrame([(i, t, "en", 1.5, True, -1) for i, t in rows], "doc_id long, text string, lang string, score double, kept boolean, n_words int")
    return frame.repartition(3)
