import duckdb
import pytest

from filinglens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text[, source]) rows, with columns that
    clash with names the operators use."""

    def make(rows):
        rows = [(*r, "src0") if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return df.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", "7 AS score", "8 AS size", "9 AS node", "'x' AS row", "1 AS n", "2 AS taken")

    return make
