"""Raw filing files (S4), the landed-filings table (K1-K3) and the
latest-filing cache table (S5, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.operators.gate import merge_latest_cache
from filinglens.operators.index import BUCKET_COL, path_exists, with_bucket
from filinglens.options import Options
from filinglens.session import ensure_checkpoint_dir

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("ticker_norm", T.StringType()),
        T.StructField("cik", T.StringType()),
        T.StructField("accession_number", T.StringType()),
        T.StructField("filing_date", T.DateType()),
        T.StructField("period_of_report", T.DateType()),
        T.StructField("primary_document", T.StringType()),
    ]
)

LANDED_SCHEMA = T.StructType(
    [T.StructField("storage_path", T.StringType()), T.StructField("content", T.BinaryType())]
)


def bytes_to_text(col) -> F.Column:
    """UTF-8 decode that drops invalid bytes (they decode to U+FFFD, which
    is then removed; a genuine U+FFFD in the text is removed too)."""
    return F.replace(F.make_valid_utf8(col.cast("string")), F.lit("\ufffd"), F.lit(""))


def read_raw_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files → (path, modified, html)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), bytes_to_text(F.col("content")).alias("html"))


def read_landed(spark: SparkSession, path: str, wanted: DataFrame | None = None, buckets: int = Options().landing_buckets) -> DataFrame:
    """Landed filings (storage_path, content). The table is partitioned by hash
    of the path; with ``wanted`` (storage_path) only the buckets and rows of
    those paths are read. The number of buckets is part of the folder's name, so
    another number reads another table."""
    table = _landing(path, buckets)
    if not path_exists(spark, table):
        return spark.createDataFrame([], LANDED_SCHEMA)
    rows = spark.read.schema(T.StructType([*LANDED_SCHEMA.fields, T.StructField(BUCKET_COL, T.IntegerType())])).parquet(table)
    if wanted is not None:
        keys = with_bucket(wanted.select("storage_path").distinct(), "storage_path", buckets)
        hit = [r[0] for r in keys.select(BUCKET_COL).distinct().collect()]  # at most one row per bucket
        rows = rows.where(F.col(BUCKET_COL).isin(hit)).join(keys, [BUCKET_COL, "storage_path"], "left_semi")
    return rows.select(*LANDED_SCHEMA.names)


def _landing(path: str, buckets: int) -> str:
    return f"{path.rstrip('/')}/by-path-{buckets}"


def land_filings(spark: SparkSession, fetched: DataFrame, path: str, buckets: int = Options().landing_buckets) -> int:
    """Append fetched filings (storage_path, html) whose path is not landed
    yet (write-if-absent as a left anti join). Returns rows appended."""
    ensure_checkpoint_dir(spark)
    landed = read_landed(spark, path, fetched, buckets).select("storage_path")
    new = fetched.join(landed, "storage_path", "left_anti").select(
        "storage_path", F.encode(F.col("html"), "UTF-8").alias("content")
    )
    new = new.checkpoint(eager=True)
    n = new.count()
    if n:
        with_bucket(new, "storage_path", buckets).hint("rebalance", BUCKET_COL).write.mode("append").partitionBy(BUCKET_COL).parquet(_landing(path, buckets))
    return n


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Latest-filing cache; an absent table reads as empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def write_cache(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Merge a batch of latest filings into the cache (newest per ticker
    wins) and rewrite it. The merge is checkpointed first, so the write does
    not read the files it replaces."""
    ensure_checkpoint_dir(spark)
    merged = merge_latest_cache(read_cache(spark, path), batch).checkpoint(eager=True)
    merged.write.mode("overwrite").parquet(path)
