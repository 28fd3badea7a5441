"""Streaming ingest: copies within the watermark are dropped, replays do
not change the index; hourly counts equal the batch aggregation."""

from pyspark.sql import functions as F

from filinglens.operators.index import read_index
from filinglens.streaming.ingest import file_stream, stream_hourly_counts, stream_ingest

HTML = "<html><body><p>Item 2. MD&amp;A</p><p>{body}</p></body></html>"


def test_stream_ingest_dedups_and_replays(spark, tmp_table):
    landing = tmp_table("arrivals")
    pages = spark.createDataFrame(
        [(i, f"https://c{i % 3}.example.com/{i}", HTML.format(body=f"text {i}")) for i in range(12)],
        "page_id long, url string, html string",
    )
    pages.coalesce(1).write.mode("append").parquet(landing)
    pages.coalesce(1).write.mode("append").parquet(landing)  # the same filings arrive again
    schema = pages.schema

    def run(checkpoint):
        stream = file_stream(spark, landing, "*.parquet", schema).withColumn(
            "company", F.regexp_extract("url", r"^https://([^/]+)/", 1)
        )
        stream_ingest(spark, stream, index_path, company_col="company", checkpoint=checkpoint)

    index_path = tmp_table("stream-index")
    run(tmp_table("ckpt1"))
    first = sorted((r.page_id, r.chunk_index, r.text) for r in read_index(spark, index_path).collect())
    assert len(first) == 12 and len({p for p, _, _ in first}) == 12
    run(tmp_table("ckpt2"))  # replay everything from a fresh checkpoint
    again = sorted((r.page_id, r.chunk_index, r.text) for r in read_index(spark, index_path).collect())
    assert again == first


def test_stream_hourly_counts_equal_batch(spark, tmp_table):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tmp_table("events")
    events.write.parquet(folder)
    out = tmp_table("hourly")
    stream_hourly_counts(spark, file_stream(spark, folder, "*.parquet", events.schema), out, checkpoint=tmp_table("ck"))
    got = {(str(r.w.start), r.event_type): r.n_events for r in spark.read.parquet(out).collect()}
    want = {
        (str(r.h), r.event_type): r.n
        for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    assert got == want


def test_old_files_corrections_and_folders_of_files(spark, tmp_table, tmp_path):
    import os

    folder = tmp_path / "in" / "pages.parquet"
    folder.mkdir(parents=True)
    schema = "page_id long, html string, company string"

    def land(name, mtime, rows):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(folder / name)
        os.utime(folder / name, (mtime, mtime))

    index_path, checkpoint = tmp_table("late"), tmp_table("late-ckpt")

    def run():
        stream = file_stream(spark, str(tmp_path / "in"), "pages.parquet", spark.createDataFrame([], schema).schema)
        stream_ingest(spark, stream, index_path, company_col="company", checkpoint=checkpoint)
        return sorted(tuple(r) for r in spark.read.parquet(index_path).select("page_id", "company", "text").collect())

    land("a.parquet", 2_000_000_000, [(1, "<p>one</p>", "x"), (3, "<p>three</p>", "x")])
    assert run() == [(1, "x", "one"), (3, "x", "three")]
    land("b.parquet", 1_999_980_000, [(2, "<p>two</p>", "x"), (3, "", "x")])  # hours older; 3 has no text any more
    land("c.parquet", 1_999_990_000, [(1, "<p>uno</p>", "y")])  # moved to another company
    land("d.parquet", 1_999_970_000, [(1, "<p>old</p>", "z")])
    assert run() == [(1, "y", "uno"), (2, "x", "two")]


def test_stream_distinct_across_batches(spark, tmp_table):
    from filinglens.streaming.ingest import stream_distinct

    folder, out, checkpoint = tmp_table("in"), tmp_table("out"), tmp_table("ck")
    schema = "id long, at timestamp, v string"

    def land(rows):
        spark.createDataFrame([(i, at, v) for i, at, v in rows], "id long, at string, v string").selectExpr("id", "to_timestamp(at) AS at", "v").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        state = stream_distinct(spark, stream, out, key=["id"], time_col="at", delay="1 hour", checkpoint=checkpoint)
        return sorted(((r["id"], r["v"]) for r in spark.read.parquet(out).collect()), key=repr), state

    land([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:05:00", "copy"), (2, "2024-01-01 00:10:00", "b"), (None, "2024-01-01 00:10:00", "null"), (None, "2024-01-01 00:11:00", "null")])
    first, _ = run()
    assert [x[0] for x in first if x[0]] == [1, 2] and len(first) == 3
    land([(1, "2024-01-01 00:30:00", "late copy"), (3, "2024-01-01 00:40:00", "c")])
    assert [x[0] for x in run()[0] if x[0]] == [1, 2, 3]
    many = [(i, f"2024-01-01 {5 + i // 60:02d}:{i % 60:02d}:00", "m") for i in range(100, 220)]
    land(many)
    land([(500, "2024-01-02 00:00:00", "day")])
    got, state = run()
    assert len(got) == 3 + 1 + 120 + 1
    land([(501, "2024-01-02 00:00:01", "day")])
    got, state = run()
    assert len(got) == 126 and state[-1] <= 3  # keys that the watermark passed are gone
    assert run()[0] == got  # nothing new, nothing written twice
