"""Small column functions: URL join, TTL, ids, dates, pluggable embedder."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.functions.dates import within_ttl
from filinglens.functions.text import accession_nodash, cik10, cik_no_zero, iso_date, join_url, normalize_ticker
from filinglens.operators.embedding import embed, embed_distinct


def test_ids_and_dates(spark):
    df = spark.createDataFrame(
        [(320193, "0000320193", "0000320193-25-000073", " aapl ", "2025-10-31"),
         (12345678901, "0000000000", "x", "msft", "2025"),
         (1, "1", "-", "", "")],
        "c long, s string, a string, t string, d string",
    )
    rows = df.select(cik10(F.col("c")).alias("c"), cik_no_zero(F.col("s")).alias("s"), accession_nodash(F.col("a")).alias("a"),
                     normalize_ticker(F.col("t")).alias("t"), iso_date(F.col("d")).alias("d")).collect()
    assert rows[0] == ("0000320193", "320193", "000032019325000073", "AAPL", dt.date(2025, 10, 31))
    assert rows[1].c == "12345678901" and rows[1].s == "" and rows[1].d is None
    assert rows[2].t == "" and rows[2].d is None


def test_join_url(spark):
    df = spark.createDataFrame([("https://h/base//", "/x/y"), ("https://h", "z")], "b string, p string")
    assert [r[0] for r in df.select(join_url(F.col("b"), F.col("p"))).collect()] == ["https://h/base/x/y", "https://h/z"]


def test_within_ttl(spark):
    now = dt.datetime(2025, 1, 1, 12, 0, 0)
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 7, 0, 0),), (dt.datetime(2025, 1, 1, 5, 59, 0),), (None,)], "t timestamp")
    got = [r[0] for r in df.select(within_ttl(F.col("t"), 6, F.lit(now).cast("timestamp"))).collect()]
    assert got == [True, False, False]


def test_user_embedder_is_arrow_batched(spark):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def length_embedder(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t)), 1.0])

    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "ab")], "id long, text string")
    got = {r.id: (r.embedding, r.embedding_norm) for r in embed(df, "text", length_embedder).collect()}
    assert got[2][0] == [4.0, 1.0] and abs(got[2][1] - 17 ** 0.5) < 1e-12
    once = {r.id: r.embedding for r in embed_distinct(df, "text", length_embedder).collect()}
    assert once == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [2.0, 1.0]}
