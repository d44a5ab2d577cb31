import pytest

from fleetlens.llm.scratch import ship_package

ROWS = [  # id, text: nulls, empty, blank, a long text, repeated rows, ties, other scripts
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "zero one two three four five six seven eight nine ten eleven twelve thirteen end"),
    (3, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (4, None), (5, ""), (6, "  \n\t "), (7, "word"), (7, "word"), (8, "word"), (None, "word"), (None, None),
    (9, "the quick brown fox " * 4000), (10, "漢字 かな  naïve ÀÉÎ x <|endoftext|> don't"), (11, "12 345 6789 !!! $$$"),
    (12, "a"), (13, "a b c"), (14, "The quick brown fox"),
]


@pytest.fixture(scope="session")
def llm_spark(spark):
    ship_package(spark)
    return spark


@pytest.fixture()
def odd_docs(llm_spark):
    """Awkward rows with extra columns whose names clash with those the operators use or return."""
    rows = [(i, t, "en", "s", 0, "x", 1.0, [1]) for i, t in ROWS]
    return llm_spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "_id string, score double, found array<int>").repartition(3)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.where("false")
