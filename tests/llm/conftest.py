import pytest

from cairn.llm.common import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, rank string"


def words(n: int, start: int = 0) -> str:
    return " ".join(f"word{i * 7919 % 1000}" for i in range(start, start + n))


LONG = words(30_000) + " " + "x" * 50_000


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, equal texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, words(60), "en", "a", 10, "k", 1, "r"),
        (2, words(60), None, None, None, None, None, None),
        (3, words(59) + " other", "en", "a", 10, "k", 1, "r"),
        (4, None, "en", "a", 10, "k", 1, "r"),
        (5, "", "en", "a", 10, "k", 1, "r"),
        (6, LONG, "en", "a", 10, "k", 1, "r"),
        (7, " \n\t ", "en", "a", 10, "k", 1, "r"),
        (8, "one two", "en", "a", 10, "k", 1, "r"),
        (8, "one two", "en", "a", 10, "k", 1, "r"),
        (None, words(40, 500), "en", "a", 10, "k", 1, "r"),
        (10, "é 😀 日本語 a  b <|endoftext|> c\r\nd", "en", "a", 10, "k", 1, "r"),
    ]
    path = str(tmp_path_factory.mktemp("awkward") / "documents")
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter("doc_id < 0")
