"""The inverted-list index: recall, pruning, upserts, hard vectors."""

import random

from pyspark.sql import functions as F

from filinglens.operators import ann
from filinglens.operators.search import cosine_topk

SCHEMA = "accession_number string, chunk long, embedding array<double>"


def clustered(spark, n, dims=16, groups=12, seed=1):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    rows = [(f"A{i % 40}", i, [x + r.gauss(0, 0.45) for x in r.choice(centers)]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def asked(df, k=10):
    return df.select(F.col("chunk").alias("query_id"), F.col("embedding").alias("qvec"), F.lit(k).alias("k"))


def test_recall_and_pruned_scan(spark, tmp_table):
    path, rows = tmp_table("ann"), clustered(spark, 1500)
    ann.upsert_ann(spark, path, rows)
    probes = ann.fit_probes(spark, path, key_cols=["chunk"])
    lists = ann.read_ann(spark, path)[1].count()
    assert lists == 39 and probes < lists / 2
    hits = ann.ann_topk(spark, path, asked(rows), key_cols=["chunk"], probes=probes)
    true = cosine_topk(rows, asked(rows), key_cols=["chunk"])
    found = true.join(hits.select("query_id", "chunk"), ["query_id", "chunk"], "left_semi").count()
    assert found >= 0.95 * 15000
    assert hits.groupBy("query_id").agg(F.max("rank").alias("r")).where("r > 10").count() == 0
    # One query reads its lists' partitions and no other.
    one = ann.ann_topk(spark, path, asked(rows.where("chunk = 7")), key_cols=["chunk"], probes=2)
    assert {tuple(x) for x in one.where("rank = 1").select("query_id", "chunk").collect()} == {(7, 7)}
    read = one._jdf.queryExecution().optimizedPlan().toString()
    assert "list" in read
    held = {x["list"] for x in ann.nearest_lists(asked(rows.where("chunk = 7")), ann.read_ann(spark, path)[1], 2, id_col="query_id", vector_col="qvec").collect()}
    inside = ann.read_ann(spark, path)[0].where(F.col("list").isin(list(held))).select("chunk")
    assert one.join(inside, "chunk", "left_anti").count() == 0


def test_upsert_replaces_filings_and_replays(spark, tmp_table):
    path, rows = tmp_table("ann"), clustered(spark, 300)
    ann.upsert_ann(spark, path, rows)
    changed = clustered(spark, 30, seed=2).withColumn("accession_number", F.lit("A3"))
    for _ in range(2):
        ann.upsert_ann(spark, path, changed)
    stored = ann.read_ann(spark, path)[0]
    want = rows.where("accession_number <> 'A3'").unionAll(changed)
    assert sorted(map(repr, stored.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    ann.upsert_ann(spark, path, rows.limit(0), filings=spark.createDataFrame([("A3",)], "accession_number string"))
    assert ann.read_ann(spark, path)[0].where("accession_number = 'A3'").count() == 0


def test_hard_vectors(spark, tmp_table):
    path = tmp_table("ann")
    rows = [("A", 1, [1.0, 0.0]), ("A", 2, [1.0, 0.0]), ("A", 3, [0.0, 1.0]), ("B", 4, None), ("B", 5, [0.0, 0.0]), ("B", 6, [float("nan"), 1.0]), ("B", 7, [None, 1.0]), (None, 8, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, SCHEMA)
    ann.upsert_ann(spark, path, df)
    assert ann.read_ann(spark, path)[0].count() == 8
    lists = ann.read_ann(spark, path)[1].count()
    out = ann.ann_topk(spark, path, asked(df, 3), key_cols=["chunk"], probes=lists)
    got = {(r["query_id"], r["rank"]): r["chunk"] for r in out.collect()}
    assert {q for q, _ in got} == {1, 2, 3, 8} and got[1, 1] == 1 and got[2, 1] == 1 and got[2, 2] == 2 and got[8, 1] == 8
    assert ann.ann_topk(spark, path, asked(df.where("chunk = 4")), key_cols=["chunk"], probes=1).count() == 0
    empty = tmp_table("none")
    ann.upsert_ann(spark, empty, df.limit(0))
    ann.upsert_ann(spark, empty, df.where("chunk = 3"))
    assert ann.fit_probes(spark, empty, key_cols=["chunk"]) == 1


def test_a_query_goes_to_groups_of_lists(spark, tmp_table, monkeypatch):
    """Not once to every list: with 20 probes of 39 lists that was 20 copies of
    each query, and 20 times k hits of each."""
    from filinglens.options import Options

    path, rows = tmp_table("ann"), clustered(spark, 1500)
    ann.upsert_ann(spark, path, rows)
    stored, centroids = ann.read_ann(spark, path)
    near = {}
    for r in ann.nearest_lists(asked(rows), centroids, 20, id_col="query_id", vector_col="qvec").collect():
        near.setdefault(r["query_id"], set()).add(r["list"])
    # Exact: every pair of a query and a row of its lists, ranked by the exact search.
    lists = spark.createDataFrame([(q, x) for q, ls in near.items() for x in ls], "query_id long, list int")
    pairs = cosine_topk(stored, asked(rows, 1500), key_cols=["chunk"]).join(stored.select("chunk", "list"), "chunk").join(lists, ["query_id", "list"])
    want = {}
    for r in pairs.orderBy("query_id", "rank").collect():
        if len(want.setdefault(r["query_id"], [])) < 10:
            want[r["query_id"]].append((r["chunk"], r["score"]))
    kind, sent = type(rows), {}
    old = kind.repartition
    for i, opts in enumerate((Options(), Options(query_block_rows=100, corpus_block_rows=2))):  # the second cuts lists
        monkeypatch.setattr(kind, "repartition", lambda self, *a: sent.setdefault(i, []).append(self) or old(self, *a))
        hits = ann.ann_topk(spark, path, asked(rows), key_cols=["chunk"], probes=20, opts=opts)
        monkeypatch.undo()
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk"], r["score"]))
        assert got == want
    # All lists are one group at first.
    assert max(x.count() for x in sent[0] if "query_id" in x.columns) == 1500
