"""Approximate search over stored chunks: an inverted-list index.

Vectors are dealt to lists by their nearest centroid; the lists are partitions
of a Parquet table beside the centroids. A query looks into the lists of its
nearest centroids only, and the rows found there are ranked by exact cosine. How
many lists it looks into is fitted to a wanted recall on sampled queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.functions.vectors import as_double_vector
from filinglens.operators.index import path_exists, replace_rows
from filinglens.operators.search import cosine_topk, list_places, listed_topk
from filinglens.options import Options

LIST_COL = "list"


def _usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has a direction: not null, without null or non-finite
    components, and not zero."""
    v = as_double_vector(F.col(vector_col))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vector_col).isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0))


def fit_centroids(vectors: DataFrame, vector_col: str = "embedding", lists: int | None = None, rows_per_list: int = 64, seed: int = 17, rounds: int = 12) -> DataFrame:
    """(list, centroid) by k-means (cosine) on at most ``rows_per_list`` rows
    per list, those with the smallest hashes. ``lists``: by default the root of
    the number of rows, so that lists, and the lists a search chooses among, both grow
    with the root. Without usable rows there are no centroids."""
    spark = vectors.sparkSession
    good = _usable(vectors, vector_col).select(as_double_vector(F.col(vector_col)).alias("v"))
    n = good.count()
    k = min(n, lists or math.ceil(math.sqrt(n)))
    if k == 0:
        return spark.createDataFrame([], "list int, centroid array<double>")
    keep = rows_per_list * k / n
    # Equal vectors hash alike: the sample doesn't depend on the file layout.
    some = good if keep >= 1 else good.where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 20)) < F.lit(math.ceil(keep * (1 << 20))))
    if k == 1:
        centers = [some.first()["v"]] if not some.isEmpty() else [good.first()["v"]]
    else:
        rows = some.orderBy(F.xxhash64(F.lit(seed), "v")).select(array_to_vector("v").alias("features"))
        centers = [c.tolist() for c in KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows).clusterCenters()]
    return spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "list int, centroid array<double>")


def nearest_lists(queries: DataFrame, centroids: DataFrame, k: int, *, id_col: str, vector_col: str, opts: Options = Options()) -> DataFrame:
    """(id, place from 1, list): the ``k`` lists whose centroids are nearest."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qvec"), F.lit(k).alias("k"))
    hits = cosine_topk(centroids, q, key_cols=["list"], vector_col="centroid", opts=opts)
    return hits.select(F.col("query_id").alias(id_col), F.col("rank").alias("place"), "list")


def _assigned(rows: DataFrame, centroids: DataFrame, vector_col: str, opts: Options) -> DataFrame:
    """``rows`` with the list of the nearest centroid; list -1 holds those without a direction."""
    # Equal vectors go to the same list, and each distinct one is assigned once.
    key = F.xxhash64(as_double_vector(F.col(vector_col)))
    keyed = rows.withColumn("_vid", key)
    distinct = _usable(keyed, vector_col).groupBy("_vid").agg(F.min(as_double_vector(F.col(vector_col))).alias("_v"))
    near = nearest_lists(distinct, centroids, 1, id_col="_vid", vector_col="_v", opts=opts).select("_vid", "list")
    usable = F.coalesce(F.exists(as_double_vector(F.col(vector_col)), lambda x: x != 0), F.lit(False))
    return keyed.join(near, "_vid", "left").withColumn(LIST_COL, F.when(usable, F.coalesce("list", F.lit(-1))).otherwise(F.lit(-1))).drop("_vid")


def upsert_ann(spark: SparkSession, path: str, batch: DataFrame, *, filing_key: str = "accession_number", vector_col: str = "embedding", filings: DataFrame | None = None,
               opts: Options = Options(), **fitting) -> None:
    """Adds the rows of ``batch`` to the index at ``path``, replacing those of
    their filings (and of ``filings``), as the chunk index does. The first batch
    fits the centroids; later ones are dealt to the same lists, and only the
    partitions they leave or enter are rewritten. Running a batch twice changes nothing."""
    if not path_exists(spark, f"{path}/centroids"):
        if batch.isEmpty():
            return
        fit_centroids(batch, vector_col, **fitting).write.parquet(f"{path}/centroids")
    centroids = spark.read.parquet(f"{path}/centroids")
    replace_rows(spark, f"{path}/lists", _assigned(batch, centroids, vector_col, opts), [LIST_COL], filing_key, filings)


def read_ann(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids")


def ann_topk(spark: SparkSession, path: str, queries: DataFrame, *, key_cols: list[str], probes: int, vector_col: str = "embedding", opts: Options = Options()) -> DataFrame:
    """query_id, rank, score and ``key_cols`` of the nearest rows by cosine in
    the ``probes`` nearest lists of every query (query_id, a long; qvec; k). Scores are exact;
    ties by the key. Only partitions that some query looks into are scanned. A query
    without a direction, or whose lists hold fewer than k rows, has fewer rows. The
    centroids go to every task; a query's lists are one value of its row."""
    rows, centroids = read_ann(spark, path)
    asked = _usable(queries.select(F.col("query_id").cast("long").alias("query_id"), as_double_vector(F.col("qvec")).alias("qvec"), F.col("k").cast("int").alias("k")), "qvec")
    near = list_places(centroids, probes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = near([x.values.to_numpy() for x in b["qvec"]]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

    split = asked.mapInArrow(placed, "query_id long, qvec array<double>, k int, lists array<int>")
    return listed_topk(rows, split, key_cols=key_cols, list_col=LIST_COL, vector_col=vector_col, opts=opts)


def fit_probes(spark: SparkSession, path: str, *, key_cols: list[str], k: int = 10, recall: float = 0.98, sample: int = 200, seed: int = 23, vector_col: str = "embedding", opts: Options = Options()) -> int:
    """The least number of lists in which ``recall`` of the true ``k`` nearest
    of at most ``sample`` stored vectors (those with the smallest hashes) are found."""
    rows, centroids = read_ann(spark, path)
    stored = rows.where(F.col(LIST_COL) >= 0)
    # The sample is bounded; its rows are numbered by their hash.
    some = stored.select(as_double_vector(F.col(vector_col)).alias("qvec")).orderBy(F.xxhash64(F.lit(seed), "qvec")).limit(sample)
    some = some.withColumn("query_id", F.xxhash64(F.lit(seed), "qvec")).dropDuplicates(["query_id"]).withColumn("k", F.lit(k)).checkpoint(eager=True)
    lists = centroids.count()
    if lists <= 1 or some.isEmpty():
        return 1
    true = cosine_topk(stored, some, key_cols=[*key_cols, LIST_COL], vector_col=vector_col, opts=opts).select("query_id", LIST_COL)
    places = nearest_lists(some, centroids, lists, id_col="query_id", vector_col="qvec", opts=opts)
    need = true.join(places, ["query_id", LIST_COL]).groupBy("place").count().orderBy("place").collect()  # a row per list at most
    total, found = sum(r["count"] for r in need), 0
    for r in need:
        found += r["count"]
        if found >= recall * total:
            return r["place"]
    return lists
