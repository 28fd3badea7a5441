"""JSON sources for the company universe (S1) and filing listings (S2).

Both are read with explicit schemas, never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.operators.filings import first_ticker, unzip_listing

# A universe file is one JSON object keyed by position ("0", "1", ...).
UNIVERSE_SCHEMA = "map<string, struct<cik_str: string, ticker: string, title: string>>"

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("entityType", T.StringType()),
        T.StructField("sic", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tickers", T.ArrayType(T.StringType())),
        T.StructField(
            "filings",
            T.StructType(
                [
                    T.StructField(
                        "recent",
                        T.StructType(
                            [
                                T.StructField(n, T.ArrayType(T.StringType()))
                                for n in ("form", "filingDate", "accessionNumber", "primaryDocument", "periodOfReport")
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)


_ENTRY = r'(?s)^\s*[{,]\s*("\d{1,18}"\s*:\s*\{.*)$'
_FRAME = r"^[\s{]*$"  # what stands around the entries


def read_ticker_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe JSON file(s) → rows (file, pos, cik_str, ticker, title).

    ``cik_str`` may be a JSON number or a string: a string field keeps the
    raw text of a number, and the entity builder casts it. ``pos`` is the
    entry's key, which numbers the positions.

    Files are read in splits that end at a closing brace, one entry a
    record, so one huge file spans many tasks. A record that is no whole entry
    (a brace inside a text, a nested object, a key that is no number)
    marks its file, and marked files alone are parsed whole; there a key that is
    no number gives the entry's place. A file that is no JSON gives no rows. The marked files'
    names pass through the driver, which lists the files anyway.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    pieces = pieces.where(~F.col("value").rlike(_FRAME))
    entry = F.regexp_extract("value", _ENTRY, 1)
    parsed = pieces.select("file", F.when(entry != "", F.from_json(F.concat(F.lit("{"), entry, F.lit("}}")), UNIVERSE_SCHEMA)).alias("m"))
    broken = [r["file"] for r in parsed.where("m IS NULL").select("file").distinct().collect()]
    whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").isin(broken))
    whole = whole.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", UNIVERSE_SCHEMA).alias("m"))
    rows = parsed.where(~F.col("file").isin(broken)).unionAll(whole) if broken else parsed
    e = rows.select("file", F.posexplode(F.map_entries("m")).alias("place", "e"))
    return e.select("file", F.coalesce(F.col("e.key").try_cast("long"), F.col("place").cast("long")).alias("pos"), "e.value.cik_str", "e.value.ticker", "e.value.title")


def read_listings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Company listing JSON → one row per filing. One document per file, or,
    with ``lines``, one per line, which is read in splits.

    Optional fields read as null; missing arrays become empty so a company
    without ``periodOfReport`` keeps its filings (with null periods).
    """
    df = spark.read.schema(LISTING_SCHEMA).option("multiLine", str(not lines).lower()).json(path)
    flat = df.select(
        F.col("cik"),
        F.col("entityType").alias("entity_type"),
        F.col("sic"),
        F.col("name").alias("company_name"),
        F.coalesce(F.col("tickers"), F.array().cast("array<string>")).alias("tickers"),
        *[F.col(f"filings.recent.{n}").alias(n) for n in ("form", "filingDate", "accessionNumber", "primaryDocument", "periodOfReport")],
    )
    rows = unzip_listing(flat, keep=["cik", "entity_type", "sic", "company_name", "tickers"])
    return rows.withColumn("ticker", first_ticker()).drop("tickers")
