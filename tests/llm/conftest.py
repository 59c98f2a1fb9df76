import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "a b"), (None, "no id here at all"), (None, None),
    (8, "x" * 30000), (9, "long " * 6000),
]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names operators use inside."""

    def build(rows, parts=3):
        rows = [(i, t, 7, "kept", [1]) for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, score int, component string, spans array<int>").repartition(parts)

    return build


@pytest.fixture(scope="session")
def edge_docs(make):
    return make(TEXTS)


@pytest.fixture(scope="session")
def no_docs(make):
    return make([])
