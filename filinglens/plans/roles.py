"""Fixture tables recast in filing roles (all derived by Spark from the
given tables, so their size grows with them).

* company universe entry  ← customer: position c_custkey, numeric CIK
  c_custkey, raw ticker ``' ' || lower(4 letters of segment) || nation``
  (many companies share a ticker: the last entry wins), title c_name.
* filing                  ← orders: one listing row per order.
* request                 ← customer: the company's raw ticker, or an
  unknown ticker for companies with a negative balance; period target for
  the BUILDING segment; force refresh for the AUTOMOBILE segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.functions.text import cik10, normalize_ticker
from filinglens.sources.tables import read_table

# Fixed fixture parameters
FORM_BY_PRIORITY = {"1-URGENT": "10-Q", "2-HIGH": "10-Q", "3-MEDIUM": "10-Q/A", "4-NOT SPECIFIED": "10-K", "5-LOW": "8-K"}
CACHE_CUT_DATE = "1999-01-01"
TARGET_PERIOD = "1997-06-30"
TARGET_SEGMENT = "BUILDING"
FORCE_SEGMENT = "AUTOMOBILE"
LANDED_STATUS = "F"
STORED_STATUS = "F"


def raw_ticker(seg: Column, nation: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.substring(seg, 1, 4)), nation.cast("string"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("pos"),
        F.col("c_custkey").cast("string").alias("cik_str"),
        raw_ticker(F.col("c_mktsegment"), F.col("c_nationkey")).alias("ticker"),
        F.col("c_name").alias("title"),
    )


def form_of(priority: Column) -> Column:
    expr = None
    for k, v in FORM_BY_PRIORITY.items():
        expr = (F.when(priority == k, v) if expr is None else expr.when(priority == k, v))
    return expr


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per filing in listing form (strings for dates, like JSON)."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    d = F.to_date("o_orderdate")
    period = F.when(F.col("o_orderstatus") != "P", F.last_day(F.add_months(F.trunc(d, "quarter"), -1)))
    f = o.select(
        F.col("o_custkey"),
        F.col("o_orderkey").alias("pos"),
        cik10(F.col("o_custkey")).alias("cik"),
        form_of(F.col("o_orderpriority")).alias("form_type"),
        d.alias("filing_date"),
        period.alias("period_of_report"),
        F.format_string("%010d-%02d-%06d", F.col("o_custkey"), F.year(d) % 100, F.col("o_orderkey")).alias(
            "accession_number"
        ),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        F.col("o_orderstatus").alias("status"),
    )
    return f.join(c, f.o_custkey == c.c_custkey).select(
        *[x for x in f.columns if x != "o_custkey"],
        normalize_ticker(raw_ticker(F.col("c_mktsegment"), F.col("c_nationkey"))).alias("ticker"),
        F.col("c_name").alias("company_name"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    t = raw_ticker(F.col("c_mktsegment"), F.col("c_nationkey"))
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("x"), F.upper(t))).otherwise(F.upper(t)).alias("ticker"),
        F.when(F.col("c_mktsegment") == TARGET_SEGMENT, F.to_date(F.lit(TARGET_PERIOD))).alias("filing_period"),
        (F.col("c_mktsegment") == FORCE_SEGMENT).alias("force_refresh"),
    )


# Events happen within a month, filings within years: an arrival's moment is
# the event's, stretched over the years of the filings.
ARRIVALS_FROM, EVENTS_FROM, STRETCH = 788_918_400, 1_704_067_200, 80


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, cik, arrived: seconds) of requests that arrive over time."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read_table(spark, sf_dir, "events").select(
        "event_id", cik10(F.col("user_id")).alias("cik"), (F.lit(ARRIVALS_FROM) + (seconds - EVENTS_FROM) * STRETCH).alias("arrived"))


def filed_at(col: str = "filing_date") -> Column:
    return F.unix_seconds(F.col(col).cast("timestamp"))


# Days for which a filing holds.
HOLDS_DAYS = {"10-K": 365, "10-Q": 91, "10-Q/A": 30, "8-K": 1}


# An insights reply (@name, @cik: the company's) and defects as replacements
# of a part of it.
INSIGHTS_REPLY = (
    '{"company_profile":{"name":"@name","ticker":"T","cik":"@cik","sector":null},'
    '"filing_metadata":{"ticker":"T","cik":"@cik","company_name":"@name","form_type":"10-Q","filing_date":"2024-05-01",'
    '"period_of_report":null,"accession_number":"A","primary_document":"d.htm"},'
    '"high_level_summary":"sound","financial_summary":{"key_metrics":{"revenue":1.5,"eps":"0.25"},"narrative":"n"},'
    '"risk_summary":[{"title":"t","description":"d","changed_since_prior":true},{"title":"u","description":"e"}],'
    '"notable_events":[{"category":"M&A","summary":"s"}],'
    '"liquidity_and_capital_structure":{"narrative":"l","leverage_metrics":{"debt_to_equity":2}},'
    '"guidance_and_outlook":{"narrative":"g","time_horizon":null},"open_questions":["q","r"]}'
)
INSIGHTS_DEFECTS = (
    ('"sector":null', '"sector":7'),
    ('{"company_profile":', '{"company":'),
    ('"ticker":"T","cik"', '"symbol":"T","cik"'),
    ('"2024-05-01"', '"2024-13-01"'),
    ('"period_of_report":null,', ''),
    ('"sound"', '5'),
    ('1.5', '"a lot"'),
    ('"title":"u",', ''),
    ('"changed_since_prior":true', '"changed_since_prior":"maybe"'),
    ('[{"category":"M&A","summary":"s"}]', '"none"'),
    ('{"narrative":"l","leverage_metrics":{"debt_to_equity":2}}', 'null'),
    ('{"debt_to_equity":2}', '[2]'),
    ('"narrative":"g",', ''),
    ('["q","r"]', '["q",null]'),
    (',"open_questions":["q","r"]', ''),
)


# What a report asks of every filing.
QUESTIONS = ("revenue and margins", "risks and uncertainties", "liquidity and outlook")

# Entries of one universe file.
UNIVERSE_FILE_ENTRIES = 500


def universe_title() -> Column:
    """Titles of every second file's entries hold braces and quotes now and then."""
    odd = (F.floor(F.col("c_custkey") / UNIVERSE_FILE_ENTRIES) % 2 == 1) & (F.col("c_custkey") % 50 == 7)
    return F.when(odd, F.concat("c_name", F.lit(' {a},"1":{b}'))).otherwise(F.col("c_name"))


def write_universe_json(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Companies as universe files: objects keyed by position, company numbers
    written as JSON numbers or, for odd ones, as text."""
    c = read_table(spark, sf_dir, "customer")
    names = [raw_ticker(F.col("c_mktsegment"), F.col("c_nationkey")).alias("ticker"), universe_title().alias("title")]
    entry = F.when(
        F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_custkey").alias("cik_str"), *names))
    ).otherwise(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("cik_str"), *names)))
    keyed = c.select(
        F.floor(F.col("c_custkey") / UNIVERSE_FILE_ENTRIES).alias("part"), "c_custkey",
        F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('":'), entry).alias("entry"))
    # At most UNIVERSE_FILE_ENTRIES entries a group.
    files = keyed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "entry"))).alias("es"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["entry"]), ","), F.lit("}"))
    files.select("part", text.alias("value")).write.partitionBy("part").text(folder)


def fetched(spark: SparkSession, sf_dir: str, archive: DataFrame) -> DataFrame:
    """(archive_url, html): what a fetcher brings of ``archive`` (filings with
    their paths). Filing n is page n modulo the number of pages; pending orders'
    filings are not to be had."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    n = (pages.agg(F.max("page_id")).first()[0] or 0) + 1
    got = archive.where("status <> 'P'").withColumn("page_id", F.pmod("pos", F.lit(n)))
    return got.join(pages, "page_id").select("archive_url", "html")
