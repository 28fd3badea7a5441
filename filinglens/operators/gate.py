"""Ingest gate (C11), accession existence (J4) and latest-filing cache (K6).

The reference decides per request with a JSON file, an in-memory store and
two network calls. Here the state is tables and each decision is a join:
the whole request table is gated in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.operators.entity import resolve_tickers
from filinglens.operators.filings import _pick_latest
from filinglens.operators.index import stored_among
from filinglens.options import Options
from filinglens.session import ensure_checkpoint_dir

CACHE_COLS = ("cik", "accession_number", "filing_date", "period_of_report", "primary_document")

ACTIONS = ("serve_cached", "unknown_ticker", "no_filing", "serve_unchanged", "ingest")


def stored_keys(index: DataFrame, company_col: str = "cik") -> DataFrame:
    """Distinct (company, accession_number) of an index; the partial
    aggregate collapses the many chunks of one filing map-side."""
    return index.select(company_col, "accession_number").dropDuplicates()


def has_accession(requests: DataFrame, index: DataFrame, company_col: str = "ticker_norm") -> DataFrame:
    """Requests (company, accession_number) that have at least one stored
    chunk (left semi join). The store's own contract checks by ticker; the
    gate checks by CIK (a company's filings may carry another ticker)."""
    return requests.join(stored_keys(index, company_col), [company_col, "accession_number"], "left_semi")


def _flag_stored(df: DataFrame, keys: DataFrame, company_col: str, acc_col: str, flag: str) -> DataFrame:
    k = keys.select(
        F.col("cik").alias(f"_{flag}_c"), F.col("accession_number").alias(f"_{flag}_a"), F.lit(True).alias(flag)
    )
    j = df.join(
        k, (df[company_col] == k[f"_{flag}_c"]) & (df[acc_col] == k[f"_{flag}_a"]), "left"
    ).drop(f"_{flag}_c", f"_{flag}_a")
    return j.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def merge_latest_cache(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert per ticker keeping the newest filing: max by (filing_date,
    accession_number). An old-period run can therefore never replace a
    newer cached filing."""
    both = cache.select("ticker_norm", *CACHE_COLS).unionByName(batch.select("ticker_norm", *CACHE_COLS))
    best = both.groupBy("ticker_norm").agg(
        F.max_by(F.struct(*CACHE_COLS), F.struct("filing_date", "accession_number")).alias("b")
    )
    return best.select("ticker_norm", *[F.col(f"b.{c}").alias(c) for c in CACHE_COLS])


def gate(
    requests: DataFrame,
    entity: DataFrame,
    cache: DataFrame,
    filings: DataFrame,
    index_keys: DataFrame,
    opts: Options = Options(),
) -> DataFrame:
    """Decide per request: serve_cached, unknown_ticker, no_filing,
    serve_unchanged or ingest.

    requests: request_id, ticker, filing_period (date, null = latest),
    force_refresh. cache: ticker_norm + CACHE_COLS. filings: listing rows
    (cik, form_type, filing_date, period_of_report, pos, accession_number,
    primary_document, ...). index_keys: distinct (cik, accession_number)
    of the chunk index.

    Stored chunks are looked up by CIK, not ticker: the ticker stored with
    a filing is the listing's first ticker, which may differ from the one
    requested.

    Stage A fires only when the requested period is null or equals the
    cached one (the reference would serve any period from the cache).
    """
    return _decide(_candidates(requests, entity, cache, filings, opts), index_keys)


def gate_with_index(
    spark: SparkSession, requests: DataFrame, entity: DataFrame, cache: DataFrame, filings: DataFrame, index_path: str, opts: Options = Options()
) -> DataFrame:
    """As ``gate``, against the stored index: the filings that the requests
    could be served from are found first, and only the index partitions that the
    key sidecar names for them are read. The candidates are checkpointed, so the
    decisions don't change when an ingest rewrites cache or index."""
    ensure_checkpoint_dir(spark)
    found = _candidates(requests, entity, cache, filings, opts).checkpoint(eager=True)
    wanted = found.select(F.explode(F.array("cached_accession_number", "fresh_accession_number")).alias("accession_number"))
    keys = stored_among(spark, index_path, wanted.where("accession_number IS NOT NULL"), opts=opts)
    return _decide(found, keys.checkpoint(eager=True))


def _candidates(requests: DataFrame, entity: DataFrame, cache: DataFrame, filings: DataFrame, opts: Options) -> DataFrame:
    """Requests with their company, cached filing and the listing's filing."""
    req = resolve_tickers(requests.withColumn("force_refresh", F.coalesce("force_refresh", F.lit(False))), entity)
    c = cache.select("ticker_norm", *[F.col(x).alias(f"cached_{x}") for x in CACHE_COLS])
    req = req.join(c, "ticker_norm", "left")

    q = filings.where(F.col("form_type").isin(list(opts.forms)))
    order = [F.col("filing_date"), -F.col("pos")]
    # One aggregation over the filings: the winner per (company, period);
    # the winner per company is the best of those (a null period is its own
    # group there, and never matches a requested period).
    latest_period = _pick_latest(q, ["cik", "period_of_report"], order)
    latest_any = _pick_latest(latest_period, ["cik"], order)
    fresh_cols = ["accession_number", "filing_date", "period_of_report", "primary_document", "form_type"]
    la = latest_any.select(F.col("cik").alias("_la_cik"), *[F.col(x).alias(f"la_{x}") for x in fresh_cols])
    lp = latest_period.select(
        F.col("cik").alias("_lp_cik"),
        F.col("period_of_report").alias("_lp_period"),
        *[F.col(x).alias(f"lp_{x}") for x in fresh_cols if x != "period_of_report"],
    )
    req = req.join(la, (req["cik"] == la["_la_cik"]) & req["filing_period"].isNull(), "left")
    req = req.join(
        lp, (req["cik"] == lp["_lp_cik"]) & (req["filing_period"] == lp["_lp_period"]), "left"
    )
    targeted = F.col("filing_period").isNotNull()
    for x in fresh_cols:
        if x == "period_of_report":
            fresh = F.when(targeted, F.col("_lp_period")).otherwise(F.col(f"la_{x}"))
        else:
            fresh = F.when(targeted, F.col(f"lp_{x}")).otherwise(F.col(f"la_{x}"))
        req = req.withColumn(f"fresh_{x}", fresh)
    req = req.drop(*[c for c in req.columns if c.startswith(("la_", "lp_", "_la_", "_lp_"))])
    return req


def _decide(req: DataFrame, index_keys: DataFrame) -> DataFrame:
    req = _flag_stored(req, index_keys, "cached_cik", "cached_accession_number", "cached_stored")
    req = _flag_stored(req, index_keys, "cik", "fresh_accession_number", "fresh_stored")

    has_cache = F.col("cached_accession_number").isNotNull()
    not_forced = ~F.col("force_refresh")
    period_ok = F.col("filing_period").isNull() | (F.col("filing_period") == F.col("cached_period_of_report"))
    unchanged = (F.col("cached_filing_date") == F.col("fresh_filing_date")) & F.col(
        "cached_period_of_report"
    ).eqNullSafe(F.col("fresh_period_of_report"))
    action = (
        F.when(has_cache & not_forced & period_ok & F.col("cached_stored"), "serve_cached")
        .when(F.col("cik").isNull(), "unknown_ticker")
        .when(F.col("fresh_accession_number").isNull(), "no_filing")
        .when(has_cache & not_forced & unchanged & F.col("fresh_stored"), "serve_unchanged")
        .otherwise("ingest")
    )
    return req.withColumn("action", action)


def reconcile(listing: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that the two tables hold a different number of times, with
    ``missing`` (listed more often than stored) and ``surplus`` (the other way round):
    EXCEPT ALL both ways as one aggregation, combined before its only
    shuffle, so that a key with very many copies is one row per task. Null keys are keys."""
    both = listing.select(*keys, F.lit(1).cast("long").alias("_n")).unionAll(index.select(*keys, F.lit(-1).cast("long").alias("_n")))
    left = both.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return left.select(*keys, F.greatest("_n", F.lit(0)).alias("missing"), F.greatest(-F.col("_n"), F.lit(0)).alias("surplus"))
