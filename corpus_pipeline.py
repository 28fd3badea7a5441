"""The corpus pipeline: quality, near duplicates, mixture, token ids.

Each stage takes the documents the one before it kept (as a written table)
and returns documents; the last returns what is written for training.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import mixture, pieces, quality, shingle_join
from filinglens.session import scratch_path
from filinglens.sources.tables import read_table


def _with(docs: DataFrame, stage, reads: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` after ``stage``, which sees those it reads and the
    others in one struct, so that none of theirs meets a column that it adds."""
    rest = [c for c in docs.columns if c not in reads]
    if not rest:
        return stage(docs).select(*docs.columns)
    out = stage(docs.select(*reads, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")))
    return out.select(*[F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier predicts as good; one fitted on the
    labelled documents of this input. Null texts are scored as empty ones."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return _with(docs, lambda own: quality.score_quality(spark, own, model).where("predicted = 1"), ("doc_id", "text"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard 0.8) the document
    with the smallest id; of rows that repeat an id and text, one. Documents
    without words or without an id are in no group and stay."""
    groups = shingle_join.shingle_components(spark, docs, k=5, percent=80)
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))

    def stay(own: DataFrame) -> DataFrame:
        kept = own.join(first, "doc_id")
        again = kept.where("_rows > 1").dropDuplicates(["doc_id", "text"])
        return kept.where("_rows = 1").unionAll(again).drop("_rows").unionByName(own.where("doc_id IS NULL"))

    return _with(docs, stay, ("doc_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, whole; the one that a
    source's target cuts is rounded. Documents the mix doesn't take are gone."""
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = lambda own: mixture.mix(spark, own).where((F.col("size") > 0) & (copies > 0))
    return _with(docs, lambda own: mixed(own).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))), ("doc_id", "text", "source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document of the mix."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# A fitted classifier and a tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
