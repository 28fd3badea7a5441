"""Company dimension (C1) and ticker resolution (C2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.functions.text import cik10, normalize_ticker


def build_entity_dim(universe: DataFrame) -> DataFrame:
    """Universe entries (pos, cik_str, ticker, title) → one row per ticker.

    ``cik_str`` may be numeric or quoted text; it becomes a 10-digit string.
    When several entries share a normalised ticker the last one (highest
    ``pos``) wins. ``max_by`` aggregates map-side first, so a ticker held
    by a third of all entries still shuffles one row per map task.
    """
    norm = universe.select(
        "pos",
        normalize_ticker(F.col("ticker")).alias("ticker_norm"),
        F.col("cik_str").cast("string").try_cast("long").alias("cik_int"),
        F.col("title").alias("company_name"),
    )
    last = norm.groupBy("ticker_norm").agg(
        F.max_by(F.struct("cik_int", "company_name"), "pos").alias("e")
    )
    return last.select(
        F.col("ticker_norm").alias("ticker"),
        cik10(F.col("e.cik_int")).alias("cik"),
        F.col("e.cik_int").alias("cik_int"),
        F.col("e.company_name").alias("company_name"),
    )


def resolve_tickers(requests: DataFrame, entity: DataFrame, ticker_col: str = "ticker") -> DataFrame:
    """Left lookup of each request's normalised ticker; a miss gets
    ``status = 'unknown_ticker'`` instead of raising."""
    req = requests.withColumn("ticker_norm", normalize_ticker(F.col(ticker_col)))
    dim = entity.select(F.col("ticker").alias("ticker_norm"), "cik", "cik_int", "company_name")
    out = req.join(dim, "ticker_norm", "left")
    return out.withColumn("status", F.when(F.col("cik").isNull(), F.lit("unknown_ticker")).otherwise(F.lit("ok")))
