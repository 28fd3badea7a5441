"""The ingest-gate cases as tables: a warm cache with the
filing stored fetches nothing; changed dates fetch and store one filing."""

import datetime as dt


from filinglens.operators.entity import build_entity_dim
from filinglens.operators.gate import gate, stored_keys
from filinglens.operators.index import path_exists, read_index
from filinglens.operators.ingest import run_ingest
from filinglens.sources.raw_files import read_cache

D = dt.date
CACHE_ROW = "ticker_norm string, cik string, accession_number string, filing_date date, period_of_report date, primary_document string"
FILING_SCHEMA = (
    "cik string, form_type string, filing_date date, period_of_report date, pos long, "
    "accession_number string, primary_document string"
)
HTML = "<html><body><p>Item 2. MD&amp;A</p><p>Revenue grew.</p><p>Item 1A. Risk Factors</p><p>Supply risk.</p></body></html>"


def setup(spark, tmp_table, cached, filings):
    universe = spark.createDataFrame([(0, "320193", "AAPL", "Apple Inc.")], "pos long, cik_str string, ticker string, title string")
    paths = {k: tmp_table(k) for k in ("landing", "index", "cache")}
    ent = build_entity_dim(universe)
    req = spark.createDataFrame([(1, "aapl", None, False)], "request_id long, ticker string, filing_period date, force_refresh boolean")
    return ent, req, paths, spark.createDataFrame(cached, CACHE_ROW), spark.createDataFrame(filings, FILING_SCHEMA)


def fetched_for(spark, acc, doc):
    url = f"https://www.sec.gov/Archives/edgar/data/320193/{acc.replace('-', '')}/{doc}"
    return spark.createDataFrame([(url, HTML)], "archive_url string, html string")


def test_skip_when_cached_and_stored(spark, tmp_table):
    cached = [("AAPL", "0000320193", "ACC-1", D(2025, 10, 31), D(2025, 9, 27), "doc.htm")]
    filings = [("0000320193", "10-Q", D(2025, 10, 31), D(2025, 9, 27), 0, "ACC-1", "doc.htm")]
    ent, req, paths, cache, f = setup(spark, tmp_table, cached, filings)
    keys = spark.createDataFrame([("0000320193", "ACC-1")], "cik string, accession_number string")
    decisions = gate(req, ent, cache, f, keys)
    assert [r.action for r in decisions.collect()] == ["serve_cached"]
    n = run_ingest(spark, decisions, fetched_for(spark, "ACC-1", "doc.htm"),
                   landing_path=paths["landing"], index_path=paths["index"], cache_path=paths["cache"])
    assert n == 0
    assert not path_exists(spark, paths["landing"]) or spark.read.parquet(paths["landing"]).count() == 0


def test_reingest_when_dates_changed(spark, tmp_table):
    cached = [("AAPL", "0000320193", "ACC-OLD", D(2025, 7, 31), D(2025, 6, 28), "old.htm")]
    filings = [
        ("0000320193", "10-Q", D(2025, 10, 31), D(2025, 9, 27), 0, "ACC-NEW", "new.htm"),
        ("0000320193", "10-Q", D(2025, 7, 31), D(2025, 6, 28), 1, "ACC-OLD", "old.htm"),
    ]
    ent, req, paths, cache, f = setup(spark, tmp_table, cached, filings)
    keys = spark.createDataFrame([], "cik string, accession_number string")
    decisions = gate(req, ent, cache, f, keys)
    assert [r.action for r in decisions.collect()] == ["ingest"]
    fetched = fetched_for(spark, "ACC-NEW", "new.htm")
    n = run_ingest(spark, decisions, fetched, landing_path=paths["landing"], index_path=paths["index"], cache_path=paths["cache"])
    assert n == 1
    idx = read_index(spark, paths["index"])
    assert {r.accession_number for r in idx.select("accession_number").distinct().collect()} == {"ACC-NEW"}
    assert {(r.section_name, r.text) for r in idx.collect()} == {("MD&A", "Revenue grew."), ("Risk Factors", "Supply risk.")}
    assert read_cache(spark, paths["cache"]).first().accession_number == "ACC-NEW"
    # the stored filing now satisfies the gate; running again lands nothing new
    again = gate(req, ent, read_cache(spark, paths["cache"]), f, stored_keys(idx))
    assert [r.action for r in again.collect()] == ["serve_cached"]
    assert run_ingest(spark, decisions, fetched, landing_path=paths["landing"], index_path=paths["index"], cache_path=paths["cache"]) == 0
    assert read_index(spark, paths["index"]).count() == 2


def test_whole_request_after_ingest(spark, tmp_table):
    from filinglens.operators.ingest import prepare_reports

    cached = []
    filings = [("0000320193", "10-Q", D(2025, 10, 31), D(2025, 9, 27), 0, "ACC-NEW", "new.htm")]
    ent, req, paths, cache, f = setup(spark, tmp_table, cached, filings)
    keys = spark.createDataFrame([], "cik string, accession_number string")
    decisions = gate(req, ent, cache, f, keys)
    run_ingest(spark, decisions, fetched_for(spark, "ACC-NEW", "new.htm"),
               landing_path=paths["landing"], index_path=paths["index"], cache_path=paths["cache"])
    context, prompts = prepare_reports(spark, decisions, read_index(spark, paths["index"]), ["revenue", "risks", "liquidity"])
    rows = context.collect()
    assert {r.question_no for r in rows} == {0, 1, 2}
    assert all(r.accession_number == "ACC-NEW" for r in rows) and len(rows) == 6
    assert "Stock Ticker / Company Name: AAPL" in prompts.first().prompt


def test_attach_vectors_checks_both_ways(spark):
    import pytest

    from filinglens.operators.embedding import UnmatchedVectors, attach_vectors

    chunks = spark.createDataFrame([("A", 0, "x"), ("A", 1, "y")], "accession_number string, chunk_index int, text string")
    good = spark.createDataFrame([("A", 0, [1.0]), ("A", 1, [0.0])], "accession_number string, chunk_index int, embedding array<float>")
    assert attach_vectors(chunks, good, ["accession_number", "chunk_index"]).count() == 2
    short = good.where("chunk_index = 0")
    with pytest.raises(UnmatchedVectors):
        attach_vectors(chunks, short, ["accession_number", "chunk_index"])
    extra = good.unionByName(spark.createDataFrame([("B", 0, [1.0])], good.schema))
    with pytest.raises(UnmatchedVectors):
        attach_vectors(chunks, extra, ["accession_number", "chunk_index"])
