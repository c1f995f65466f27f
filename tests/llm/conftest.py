import pytest

#: Nulls, empty and blank texts, ties, repeated rows, special strings, a long text; id 7 twice, null ids.
ODD = [
    (1, "Hello world, it's a test! 42 numbers"), (2, ""), (3, None), (None, "null id text"), (4, "  lead   and\n\n trail  \t"),
    (5, "Ça été naïve – “quoted” 日本語 \U0001f600 é İstanbul ΣΑΣ"), (6, "a <|endoftext|> b <|startoftext|> c"),
    (7, "same row"), (7, "same row"), (8, "x" * 9000), (9, "word " * 6000), (10, "ctrl\x1cchars\x85and\xa0blanks　wide"), (None, None),
]


@pytest.fixture()
def odd(spark):
    """The odd rows with extra columns whose names clash with those that operators use inside."""
    rows = [(i, t, 1, "x", "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string, start string")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string")
