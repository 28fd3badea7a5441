"""Filing listings: unzip parallel arrays (J2), pick latest / period /
amended / recent-N filings (C3, X1, X3, X4), paths (P4-P7), downloads (J5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglens.functions.text import accession_nodash, cik_no_zero, iso_date
from filinglens.options import ARCHIVES_BASE, Options

LISTING_ARRAYS = ("form", "filingDate", "accessionNumber", "primaryDocument", "periodOfReport")

FILING_COLS = (
    "ticker", "cik", "company_name", "form_type", "filing_date",
    "period_of_report", "accession_number", "primary_document",
)


def unzip_listing(listing: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Company listing rows with parallel arrays → one row per filing.

    Every array is coalesced to ``[]`` first: a missing array (e.g. no
    ``periodOfReport``) would otherwise make ``arrays_zip`` null and drop
    the company. Shorter arrays are padded with nulls. ``pos`` is the
    position in the listing. Dates are parsed from ISO text; bad text → null.
    """
    keep = keep if keep is not None else [c for c in listing.columns if c not in LISTING_ARRAYS]
    arrays = [F.coalesce(F.col(a), F.array().cast("array<string>")).alias(a) for a in LISTING_ARRAYS]
    z = listing.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "f"))
    return z.select(
        *keep,
        "pos",
        F.col("f.form").alias("form_type"),
        iso_date(F.col("f.filingDate")).alias("filing_date"),
        F.col("f.accessionNumber").alias("accession_number"),
        F.col("f.primaryDocument").alias("primary_document"),
        iso_date(F.col("f.periodOfReport")).alias("period_of_report"),
    )


def first_ticker(tickers_col: str = "tickers"):
    """``tickers[0]`` or '' (no error on an empty or missing list)."""
    return F.coalesce(F.get(F.col(tickers_col), 0), F.lit(""))


def _pick_latest(filings: DataFrame, company_cols: list[str], order: list) -> DataFrame:
    cols = [c for c in filings.columns if c not in company_cols]
    best = filings.groupBy(*company_cols).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("b"))
    return best.select(*company_cols, *[F.col(f"b.{c}").alias(c) for c in cols])


def select_latest(
    filings: DataFrame,
    opts: Options = Options(),
    company_cols: tuple[str, ...] = ("cik",),
    target_period=None,
) -> DataFrame:
    """Latest quarterly filing per company (C3).

    Filter to the quarterly forms, optionally to ``period_of_report =
    target_period`` (a date or Column; null means no target), then arg-max
    by (filing_date desc, listing position asc). ``max_by`` runs as a
    partial aggregate before the shuffle, so a company holding a third of
    all filings still costs one row per map task.
    """
    f = filings.where(F.col("form_type").isin(list(opts.forms)))
    if target_period is not None:
        tp = target_period if not isinstance(target_period, str) else F.to_date(F.lit(target_period))
        f = f.where(tp.isNull() | (F.col("period_of_report") == tp))
    return _pick_latest(f, list(company_cols), [F.col("filing_date"), -F.col("pos")])


def select_latest_amended(
    filings: DataFrame, opts: Options = Options(), company_cols: tuple[str, ...] = ("cik",)
) -> DataFrame:
    """As ``select_latest`` but an amended form wins a same-day tie (X3)."""
    f = filings.where(F.col("form_type").isin(list(opts.forms)))
    amended = F.col("form_type").isin(list(opts.amended_forms)).cast("int")
    return _pick_latest(f, list(company_cols), [F.col("filing_date"), amended, -F.col("pos")])


def select_for_quarter(
    filings: DataFrame, quarter_start: str, opts: Options = Options(), company_cols: tuple[str, ...] = ("cik",)
) -> DataFrame:
    """Latest quarterly filing whose period falls in the fiscal quarter
    starting at ``quarter_start`` (X4)."""
    f = filings.where(
        F.col("form_type").isin(list(opts.forms))
        & (F.trunc("period_of_report", "quarter") == F.to_date(F.lit(quarter_start)))
    )
    return _pick_latest(f, list(company_cols), [F.col("filing_date"), -F.col("pos")])


def recent_filings(
    filings: DataFrame, n: int, opts: Options = Options(), company_cols: tuple[str, ...] = ("cik",)
) -> DataFrame:
    """Last ``n`` quarterly filings per company with their rank (X1).

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before
    the exchange, so each map task forwards at most ``n`` rows per company.
    """
    f = filings.where(F.col("form_type").isin(list(opts.forms)))
    w = Window.partitionBy(*company_cols).orderBy(F.col("filing_date").desc(), F.col("pos").asc())
    return f.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)


def filing_paths(filings: DataFrame) -> DataFrame:
    """Archive URL and landing path of each filing (P4-P7).

    The landing path keeps a form's slash (``10-Q/A`` adds a folder level);
    it is a name only: no partition value is ever parsed back from it.
    """
    url = F.concat_ws(
        "/",
        F.lit(ARCHIVES_BASE),
        cik_no_zero(F.col("cik")),
        accession_nodash(F.col("accession_number")),
        F.col("primary_document"),
    )
    path = F.concat_ws(
        "/",
        F.lit("filings"),
        F.col("ticker"),
        F.col("cik"),
        F.col("form_type"),
        F.col("accession_number"),
        F.col("primary_document"),
    )
    return filings.withColumn("archive_url", url).withColumn("storage_path", path)


def pending_downloads(wanted: DataFrame, landed: DataFrame, key: str = "storage_path") -> DataFrame:
    """Filings whose landing path is not yet written (left anti join)."""
    return wanted.join(landed.select(key).distinct(), key, "left_anti")
