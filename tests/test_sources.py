"""JSON sources, raw bytes, entity dimension and listing selection."""

import json


from filinglens.operators.entity import build_entity_dim
from filinglens.operators.filings import select_latest, select_latest_amended
from filinglens.sources.filings_json import read_listings, read_ticker_universe
from filinglens.sources.raw_files import read_raw_files


def test_universe_json(spark, tmp_table):
    import os

    folder = tmp_table("universe")
    os.makedirs(folder.replace("file:", ""), exist_ok=True)
    data = {
        "0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple Inc."},
        "1": {"cik_str": "789019", "ticker": " MSFT ", "title": "Microsoft"},
        "2": {"cik_str": 12345678901, "ticker": "AAPL", "title": "Apple Again"},
    }
    path = folder.replace("file:", "") + "/company_tickers.json"
    with open(path, "w") as f:
        json.dump(data, f)
    ent = {r.ticker: r for r in build_entity_dim(read_ticker_universe(spark, path)).collect()}
    assert set(ent) == {"AAPL", "MSFT"}
    assert ent["AAPL"].company_name == "Apple Again" and ent["AAPL"].cik == "12345678901"
    assert ent["MSFT"].cik == "0000789019" and ent["MSFT"].cik_int == 789019


def test_listing_json(spark, tmp_table):
    import os

    folder = tmp_table("listings").replace("file:", "")
    os.makedirs(folder, exist_ok=True)
    docs = [
        {
            "cik": "0000320193", "name": "Apple Inc.", "tickers": ["AAPL", "AAPL.X"],
            "filings": {"recent": {
                "form": ["10-Q", "10-K", "10-Q/A", "10-Q"],
                "filingDate": ["2025-10-31", "2025-11-01", "2025-10-31", "2025-07-31"],
                "accessionNumber": ["A1", "A2", "A3", "A4"],
                "primaryDocument": ["a1.htm", "a2.htm", "a3.htm", "a4.htm"],
                "periodOfReport": ["2025-09-27", "2025-09-27", "", "2025-06-28"],
            }},
        },
        {  # no periodOfReport, no tickers
            "cik": "0000000002", "name": "NoPeriod",
            "filings": {"recent": {"form": ["10-Q"], "filingDate": ["2024-05-01"], "accessionNumber": ["B1"], "primaryDocument": ["b.htm"]}},
        },
    ]
    for i, d in enumerate(docs):
        with open(f"{folder}/CIK{i}.json", "w") as f:
            json.dump(d, f)
    rows = read_listings(spark, folder)
    assert rows.count() == 5
    latest = {r.cik: r for r in select_latest(rows).collect()}
    assert latest["0000320193"].accession_number == "A1"  # same-day tie: listing order
    assert latest["0000320193"].ticker == "AAPL"
    assert latest["0000000002"].period_of_report is None and latest["0000000002"].ticker == ""
    amended = {r.cik: r for r in select_latest_amended(rows).collect()}
    assert amended["0000320193"].accession_number == "A3"
    targeted = select_latest(rows, target_period="2025-06-28").collect()
    assert [r.accession_number for r in targeted] == ["A4"]


def test_raw_bytes_drop_invalid_utf8(spark, tmp_table):
    import os

    folder = tmp_table("raw").replace("file:", "")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/f.htm", "wb") as f:
        f.write(b"<p>caf\xc3\xa9 \xff\xfeok</p>")
    got = read_raw_files(spark, folder).select("html").first().html
    assert got == "<p>café ok</p>"


def test_select_for_quarter(spark):
    import datetime as dt

    from filinglens.operators.filings import select_for_quarter

    rows = [
        ("C1", "10-Q", dt.date(2025, 8, 1), dt.date(2025, 6, 28), 0, "A"),
        ("C1", "10-Q", dt.date(2025, 8, 5), dt.date(2025, 6, 30), 1, "B"),
        ("C1", "10-Q", dt.date(2025, 11, 1), dt.date(2025, 9, 27), 2, "C"),
        ("C2", "10-K", dt.date(2025, 8, 1), dt.date(2025, 6, 30), 0, "D"),
    ]
    f = spark.createDataFrame(rows, "cik string, form_type string, filing_date date, period_of_report date, pos long, accession_number string")
    got = [(r.cik, r.accession_number) for r in select_for_quarter(f, "2025-04-01").collect()]
    assert got == [("C1", "B")]


def universe_of(spark, folder, files):
    import os

    local = folder.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    for name, text in files.items():
        with open(f"{local}/{name}", "w") as f:
            f.write(text)
    return read_ticker_universe(spark, folder)


def entries(df):
    return sorted((r.pos, r.cik_str, r.ticker, r.title) for r in df.collect())


def test_universe_is_read_in_splits(spark, tmp_table):
    data = {str(i): {"cik_str": i, "ticker": f"T{i}", "title": f"Name é {i}, \"Q\" \\ {{"} for i in range(3000)}
    want = [(i, str(i), f"T{i}", data[str(i)]["title"]) for i in range(3000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for indent in (None, 2):
            df = universe_of(spark, tmp_table("split"), {"u.json": json.dumps(data, indent=indent)})
            assert df.rdd.getNumPartitions() > 10
            assert entries(df) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_universe_files_that_splits_cannot_read_are_read_whole(spark, tmp_table):
    def one(title, **more):
        return {"cik_str": 1, "ticker": "T", "title": title, **more}

    odd = {"0": one("a } b"), "1": one('x},"5":{"cik_str":7'), "2": one("plain")}
    files = {
        "clean.json": json.dumps({"7": one("clean")}),
        "braces.json": json.dumps(odd),
        "nested.json": json.dumps({"0": one("nested", x={"y": {}})}),
        "named.json": json.dumps({"first": one("f"), "second": one("s")}),
        "empty.json": "{}",
        "nothing.json": "",
        "cut.json": '{"0":{"cik_str":1,"ticker":"T","title":"whole"},"1":{"cik_str":2,"ti',
    }
    got = entries(universe_of(spark, tmp_table("odd"), files))
    want = [(7, "clean"), (0, "a } b"), (1, 'x},"5":{"cik_str":7'), (2, "plain"), (0, "nested"), (0, "f"), (1, "s")]
    assert got == sorted((p, "1", "T", t) for p, t in want)


def test_listing_lines(spark, tmp_table):
    import os

    folder = tmp_table("lines").replace("file:", "")
    os.makedirs(folder, exist_ok=True)
    recent = {"form": ["10-Q"], "filingDate": ["2024-05-01"], "accessionNumber": ["B1"], "primaryDocument": ["b.htm"]}
    with open(f"{folder}/bulk.json", "w") as f:
        f.write(json.dumps({"cik": "1", "tickers": ["A", "B"], "filings": {"recent": recent}}) + "\n")
        f.write(json.dumps({"cik": "2", "tickers": [], "filings": {"recent": recent}}) + "\n")
        f.write('{"cik": "3", "tick\n')
    got = sorted((r.cik, r.ticker, r.period_of_report) for r in read_listings(spark, folder, lines=True).collect())
    assert got == [("1", "A", None), ("2", "", None)]


def test_landed_paths_are_read_by_bucket(spark, tmp_table):
    from filinglens.sources.raw_files import land_filings, read_landed

    path = tmp_table("landing")
    rows = spark.createDataFrame([(f"p{i}", f"html {i}") for i in range(40)], "storage_path string, html string")
    assert land_filings(spark, rows, path) == 40 and land_filings(spark, rows, path) == 0
    wanted = spark.createDataFrame([("p3",), ("p3",), (None,), ("absent",)], "storage_path string")
    some = read_landed(spark, path, wanted)
    assert [(r.storage_path, bytes(r.content).decode()) for r in some.collect()] == [("p3", "html 3")]
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString()
    assert read_landed(spark, path).count() == 40
