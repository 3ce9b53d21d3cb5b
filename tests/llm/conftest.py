"""A session with a shared folder of its own, and small tables of awkward documents."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shared(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(autouse=True)
def place(spark, shared):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", shared)


@pytest.fixture
def make(spark):
    """A documents table from texts, or from whole rows, with columns whose names operators use themselves."""

    def table(rows, partitions=3):
        rows = [r if isinstance(r, tuple) else (n, r) for n, r in enumerate(rows)]
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
        return docs.selectExpr("*", "'x' AS keep_id", "1 AS size", "2L AS node", "'y' AS ids", "0 AS component", "'z' AS digest", "3 AS copies")

    return table


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
