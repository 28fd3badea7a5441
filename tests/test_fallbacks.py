"""Grounding by key joins, and spreading of under-split inputs."""

from filinglens.operators import metrics
from filinglens.operators.joins import spread


def test_grounding_long_short_and_odd_claims(spark):
    docs = [
        (1, "alpha beta gamma delta epsilon zeta eta"), (2, "xx alpha beta gamma delta yy"), (3, "ab"), (4, ""), (5, None),
        (6, "  two  spaces\nline\u00e9 "),
    ]
    texts = [
        "beta gamma delta", "alpha beta gamma delta epsilon zeta", "a", "gamma delta zz", "", " ", "  ", "eta", "pha be",
        "ab", "abc", "e\u00e9 ", "nothing here at all", None, "beta gamma delta", "mma delta e", "spaces\nline\u00e9",
    ]
    claims = list(enumerate(texts, 10))
    got = metrics.grounding(
        spark.createDataFrame(claims, "item_id long, text string"),
        spark.createDataFrame(docs, "doc_id long, text string"),
        "item_id", "doc_id",
    ).collect()
    want = [(i, sum(d is not None and t in d for _, d in docs) if t is not None else 0) for i, t in claims]
    assert sorted((r.item_id, r.n_docs) for r in got) == want
    assert all(r.grounded == (r.n_docs > 0) for r in got)


def test_grounding_without_claims(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert metrics.grounding(none, docs, "item_id", "doc_id").count() == 0


def test_spread_is_noop_when_split_enough(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, numPartitions=cores * 2)
    assert spread(wide) is wide
    narrow = spark.range(0, 100, numPartitions=1)
    assert spread(narrow, "id").rdd.getNumPartitions() == cores
