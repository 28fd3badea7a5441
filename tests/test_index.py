"""Chunk index upsert: replace by filing, idempotent, no stale tail."""


from filinglens.operators.index import read_index, upsert_chunks


def batch(spark, rows):
    return spark.createDataFrame(rows, "accession_number string, cik string, chunk_index int, text string")


def test_upsert_replaces_whole_filing(spark, tmp_table):
    path = tmp_table("index")
    upsert_chunks(spark, path, batch(spark, [("A", "c1", 0, "a0"), ("A", "c1", 1, "a1"), ("B", "c2", 0, "b0")]))
    second = batch(spark, [("A", "c1", 0, "a0-new")])
    upsert_chunks(spark, path, second)
    upsert_chunks(spark, path, second)  # replay: no change
    got = sorted((r.accession_number, r.chunk_index, r.text) for r in read_index(spark, path).collect())
    assert got == [("A", 0, "a0-new"), ("B", 0, "b0")]
    assert read_index(spark, path).select("bucket").distinct().count() >= 1


def test_search_prunes_buckets(spark, tmp_table):
    from filinglens.operators.search import search

    path = tmp_table("index-search")
    rows = [(f"ACC-{c}-{i}", f"{c:010d}", "T", 0, "S", i, f"t{c}{i}", [1.0, float(i)]) for c in range(20) for i in range(3)]
    df = spark.createDataFrame(
        rows, "accession_number string, cik string, ticker_norm string, section_order int, section_name string, chunk_index int, text string, embedding array<double>"
    )
    upsert_chunks(spark, path, df)
    idx = read_index(spark, path)
    q = spark.createDataFrame([(1, [1.0, 0.0], 2, "0000000003"), (2, [0.0, 1.0], 2, "0000000007")], "query_id long, qvec array<double>, k int, cik string")
    key = ["accession_number", "section_order", "chunk_index"]
    pruned = search(idx, q, key_cols=key)
    plain = search(idx, q, key_cols=key, partition_col=None)
    assert sorted(pruned.collect()) == sorted(plain.collect())
    assert {r.accession_number.split("-")[1] for r in pruned.collect()} == {"3", "7"}
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    import re

    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)\]", plan), plan
    # Wanted values reach the scan's rows by a join on the route, not by a list
    # that grows with the queries.
    assert "In(cik" not in plan


def test_upsert_with_year_partitions(spark, tmp_table):
    import datetime as dt
    import glob

    path = tmp_table("index-year")
    schema = "accession_number string, cik string, filing_date date, chunk_index int, text string"
    first = spark.createDataFrame(
        [("A", "c1", dt.date(2024, 5, 1), 0, "a0"), ("A", "c1", dt.date(2024, 5, 1), 1, "a1"), ("B", "c1", dt.date(2025, 2, 1), 0, "b0")],
        schema,
    )
    upsert_chunks(spark, path, first, date_col="filing_date")
    again = spark.createDataFrame([("A", "c1", dt.date(2024, 5, 1), 0, "a0-new")], schema)
    upsert_chunks(spark, path, again, date_col="filing_date")
    upsert_chunks(spark, path, again, date_col="filing_date")
    got = sorted((r.accession_number, r.chunk_index, r.text, r.filing_year) for r in read_index(spark, path).collect())
    assert got == [("A", 0, "a0-new", 2024), ("B", 0, "b0", 2025)]
    local = path.replace("file:", "")
    assert sorted(p.split("/")[-1] for p in glob.glob(local + "/filing_year=*")) == ["filing_year=2024", "filing_year=2025"]


def rows_of(spark, path, *cols):
    return sorted(tuple(r) for r in read_index(spark, path).select(*cols).collect())


def test_null_dates_moves_empty_batches_and_vanished_filings(spark, tmp_table):
    schema = "accession_number string, cik string, filing_date date, text string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    path = tmp_table("odd-index")
    upsert_chunks(spark, path, make([]), date_col="filing_date")  # nothing, and no folder without a schema
    upsert_chunks(spark, path, make([("A", "c1", None, "a"), ("B", "c1", None, "b"), ("C", "c2", None, "c")]), date_col="filing_date")
    upsert_chunks(spark, path, make([("A", "c1", None, "a2")]), date_col="filing_date")
    assert rows_of(spark, path, "accession_number", "text") == [("A", "a2"), ("B", "b"), ("C", "c")]
    upsert_chunks(spark, path, make([]), date_col="filing_date")
    upsert_chunks(spark, path, make([("C", "c9", None, "moved")]), date_col="filing_date")
    assert rows_of(spark, path, "accession_number", "cik", "text") == [("A", "c1", "a2"), ("B", "c1", "b"), ("C", "c9", "moved")]
    gone = spark.createDataFrame([("A",), ("C",)], "accession_number string")
    upsert_chunks(spark, path, make([]), date_col="filing_date", filings=gone)
    assert rows_of(spark, path, "accession_number") == [("B",)]


def sidecar(spark, path, slots=64):
    from filinglens.operators.index import sidecar_path

    return sorted((r.accession_number, r.bucket) for r in spark.read.parquet(sidecar_path(path, slots)).collect())


def held(spark, path):
    return sorted({(r.accession_number, r.bucket) for r in read_index(spark, path).collect() if r.accession_number is not None})


def test_sidecar_follows_moves_replays_and_vanished_filings(spark, tmp_table):
    path = tmp_table("keyed")
    upsert_chunks(spark, path, batch(spark, [("A", "c1", 0, "a0"), ("A", "c1", 1, "a1"), ("B", "c2", 0, "b0"), (None, "c3", 0, "n")]))
    assert sidecar(spark, path) == held(spark, path)
    upsert_chunks(spark, path, batch(spark, [("A", "c9", 0, "moved"), ("C", "c1", 0, "c0")]))
    assert sidecar(spark, path) == held(spark, path) and len(sidecar(spark, path)) == 3
    upsert_chunks(spark, path, batch(spark, [("A", "c9", 0, "moved"), ("C", "c1", 0, "c0")]))  # replay
    assert sidecar(spark, path) == held(spark, path)
    upsert_chunks(spark, path, batch(spark, []), filings=spark.createDataFrame([("B",)], "accession_number string"))
    assert sidecar(spark, path) == held(spark, path) and "B" not in dict(sidecar(spark, path))


def test_sidecar_is_built_for_an_index_without_one_and_never_read_stale(spark, tmp_table):
    import shutil

    from filinglens.operators.index import sidecar_path, stored_among
    from filinglens.options import Options

    path = tmp_table("unkeyed")
    upsert_chunks(spark, path, batch(spark, [("A", "c1", 0, "a0"), ("B", "c2", 0, "b0")]))
    wanted = spark.createDataFrame([("A",), ("A",), (None,), ("Z",)], "accession_number string")
    few = Options(key_slots=3)
    assert [tuple(r) for r in stored_among(spark, path, wanted, opts=few).collect()] == [("c1", "A")]
    upsert_chunks(spark, path, batch(spark, [("A", "c7", 0, "moved")]), opts=few)
    assert sidecar(spark, path, 3) == held(spark, path)
    shutil.rmtree(sidecar_path(path, 3).replace("file:", ""))
    assert [tuple(r) for r in stored_among(spark, path, wanted, opts=few).collect()] == [("c7", "A")]
    assert stored_among(spark, tmp_table("absent"), wanted).collect() == []
    assert stored_among(spark, path, wanted.where("false"), opts=few).collect() == []
    # An index that was deleted and begun anew forgets its old places.
    shutil.rmtree(path.replace("file:", ""))
    upsert_chunks(spark, path, batch(spark, [("D", "c1", 0, "d0")]), opts=few)
    assert sidecar(spark, path, 3) == held(spark, path) == [("D", held(spark, path)[0][1])]


def test_lookup_scans_candidate_partitions_only(spark, tmp_table):
    import re

    from filinglens.operators.index import stored_among

    path = tmp_table("pruned")
    # One company holds a third of all filings: many rows, one bucket.
    upsert_chunks(spark, path, batch(spark, [(f"F{i}", "hot" if i % 3 == 0 else f"c{i}", j, "t") for i in range(150) for j in range(2)]))
    got = stored_among(spark, path, spark.createDataFrame([("F3",), ("F4",), ("none",)], "accession_number string"))
    assert sorted(tuple(r) for r in got.collect()) == [("c4", "F4"), ("hot", "F3")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)\]", plan), plan
    assert held(spark, path) == sidecar(spark, path)
