"""Cache round trip, date-only match and every branch of the ingest gate."""

import datetime as dt

from pyspark.sql import functions as F

from filinglens.operators.entity import build_entity_dim
from filinglens.operators.gate import gate
from filinglens.sources.raw_files import read_cache, write_cache

D = dt.date

FILING_SCHEMA = (
    "cik string, form_type string, filing_date date, period_of_report date, pos long, "
    "accession_number string, primary_document string"
)
CACHE_ROW = "ticker_norm string, cik string, accession_number string, filing_date date, period_of_report date, primary_document string"


def test_cache_round_trip(spark, tmp_table):
    path = tmp_table("cache")
    assert read_cache(spark, path).count() == 0
    batch = spark.createDataFrame(
        [("AAPL", "0000320193", "ACC-1", D(2025, 10, 31), D(2025, 9, 27), "doc.htm")], CACHE_ROW
    )
    write_cache(spark, batch, path)
    got = read_cache(spark, path).where(F.col("ticker_norm") == F.upper(F.lit("aapl"))).collect()
    assert len(got) == 1 and got[0].accession_number == "ACC-1" and got[0].period_of_report == D(2025, 9, 27)
    # an older filing never replaces a newer cached one
    old = spark.createDataFrame([("AAPL", "0000320193", "ACC-OLD", D(2025, 7, 31), D(2025, 6, 28), "d.htm")], CACHE_ROW)
    write_cache(spark, old, path)
    assert read_cache(spark, path).first().accession_number == "ACC-1"


def _gate(spark, requests, cache_rows, filings, stored):
    universe = spark.createDataFrame(
        [(0, "320193", "aapl", "Apple Inc."), (1, "789019", "MSFT", "Microsoft"), (2, "111", "NOQ", "No Q Corp")],
        "pos long, cik_str string, ticker string, title string",
    )
    ent = build_entity_dim(universe)
    cache = spark.createDataFrame(cache_rows, CACHE_ROW)
    f = spark.createDataFrame(filings, FILING_SCHEMA)
    keys = spark.createDataFrame(stored, "cik string, accession_number string")
    req = spark.createDataFrame(requests, "request_id long, ticker string, filing_period date, force_refresh boolean")
    return {r.request_id: r.action for r in gate(req, ent, cache, f, keys).collect()}


def test_gate_branches(spark):
    filings = [
        ("0000320193", "10-Q", D(2025, 10, 31), D(2025, 9, 27), 0, "ACC-1", "doc.htm"),
        ("0000320193", "10-Q", D(2025, 7, 31), D(2025, 6, 28), 1, "ACC-OLD", "old.htm"),
        ("0000789019", "10-Q", D(2025, 10, 31), D(2025, 9, 30), 0, "ACC-NEW", "n.htm"),
        ("0000000111", "10-K", D(2025, 3, 1), None, 0, "ACC-K", "k.htm"),
    ]
    cache = [
        ("AAPL", "0000320193", "ACC-1", D(2025, 10, 31), D(2025, 9, 27), "doc.htm"),
        ("MSFT", "0000789019", "ACC-OLDM", D(2025, 7, 31), D(2025, 6, 30), "o.htm"),
    ]
    stored = [("0000320193", "ACC-1")]
    requests = [
        (1, "aapl", None, False),  # cached and stored: skip everything
        (2, "MSFT", None, False),  # dates changed: ingest the new filing
        (3, "AAPL", None, True),  # forced refresh
        (4, "ZZZZ", None, False),  # unknown ticker
        (5, "NOQ", None, False),  # no quarterly filing
        (6, "AAPL", D(2025, 6, 28), False),  # other period than cached
    ]
    got = _gate(spark, requests, cache, filings, stored)
    assert got == {1: "serve_cached", 2: "ingest", 3: "ingest", 4: "unknown_ticker", 5: "no_filing", 6: "ingest"}


def test_gate_same_dates_other_accession(spark):
    # cached accession is not stored, but the fresh one (same dates) is
    filings = [("0000320193", "10-Q/A", D(2025, 10, 31), D(2025, 9, 27), 0, "ACC-2", "doc2.htm")]
    cache = [("AAPL", "0000320193", "ACC-1", D(2025, 10, 31), D(2025, 9, 27), "doc.htm")]
    got = _gate(spark, [(1, "AAPL", None, False)], cache, filings, [("0000320193", "ACC-2")])
    assert got == {1: "serve_unchanged"}
    got = _gate(spark, [(1, "AAPL", None, False)], cache, filings, [])
    assert got == {1: "ingest"}


def test_gate_checks_store_by_cik(spark):
    # the chunks were stored under the listing's first ticker, not the one
    # requested: the lookup by CIK still finds them
    filings = [("0000320193", "10-Q", D(2025, 10, 31), D(2025, 9, 27), 0, "ACC-1", "doc.htm")]
    cache = [("AAPL", "0000320193", "ACC-1", D(2025, 10, 31), D(2025, 9, 27), "doc.htm")]
    got = _gate(spark, [(1, "AAPL", None, False)], cache, filings, [("0000320193", "ACC-1")])
    assert got == {1: "serve_cached"}


def test_reconcile(spark):
    from filinglens.operators.gate import reconcile

    listed = [("a", "1")] * 500 + [("a", "2"), ("b", None), (None, None), ("c", "9")]
    stored = [("a", "1")] * 498 + [("a", "2")] * 3 + [("d", "4"), (None, None), ("b", None), ("b", None)]
    schema = "cik string, accession_number string"
    keys = ["cik", "accession_number"]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, reconcile(frame(listed), frame(stored), keys).collect()), key=repr)
    assert got == sorted([("a", "1", 2, 0), ("a", "2", 0, 2), ("b", None, 0, 1), ("c", "9", 1, 0), ("d", "4", 0, 1)], key=repr)
    assert reconcile(frame([]), frame([]), keys).count() == 0
    assert [tuple(r) for r in reconcile(frame([("x", "y")]), frame([]), keys).collect()] == [("x", "y", 1, 0)]
