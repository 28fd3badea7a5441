"""Ingest run over every gated filing (C12).

gate rows with ``action = 'ingest'`` → landing paths → write-if-absent of the
fetched HTML → parse → embed → upsert into the chunk index → merge the
latest-filing cache. The cache is written only after the index write has
succeeded (a failure in between leaves the cache stale, which is safe: the
gate also checks the index).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.operators.embedding import Embedder, embed
from filinglens.operators.filings import filing_paths
from filinglens.operators.index import upsert_chunks
from filinglens.operators.parse import parse_filings
from filinglens.options import Options
from filinglens.sources.raw_files import bytes_to_text, land_filings, read_landed, write_cache

CACHE_COLUMNS = ("ticker_norm", "cik", "accession_number", "filing_date", "period_of_report", "primary_document")


def filings_to_ingest(decisions: DataFrame) -> DataFrame:
    """Gate output → one row per distinct filing to ingest, in filing
    metadata form."""
    d = decisions.where(F.col("action") == "ingest")
    return d.select(
        F.col("ticker_norm").alias("ticker"),
        "ticker_norm",
        "cik",
        F.col("fresh_form_type").alias("form_type"),
        F.col("fresh_accession_number").alias("accession_number"),
        F.col("fresh_filing_date").alias("filing_date"),
        F.col("fresh_period_of_report").alias("period_of_report"),
        F.col("fresh_primary_document").alias("primary_document"),
    ).dropDuplicates(["accession_number"])


def run_ingest(
    spark: SparkSession,
    decisions: DataFrame,
    fetched: DataFrame,
    *,
    landing_path: str,
    index_path: str,
    cache_path: str,
    embedder: Embedder | None = None,
    opts: Options = Options(),
) -> int:
    """Ingest every filing the gate marked; returns the number of filings
    newly landed. ``fetched`` holds (archive_url, html) for the filings a
    fetcher retrieved (the network part is outside Spark)."""
    todo = filing_paths(filings_to_ingest(decisions))
    # A filing fetched twice lands once; its largest text counts.
    once = fetched.groupBy("archive_url").agg(F.max("html").alias("html"))
    wanted = todo.join(once, "archive_url")
    n_new = land_filings(spark, wanted.select("storage_path", "html"), landing_path, opts.landing_buckets)
    raw = read_landed(spark, landing_path, todo, opts.landing_buckets).select("storage_path", bytes_to_text(F.col("content")).alias("html"))
    docs = todo.join(raw, "storage_path")
    meta = ["ticker_norm", "cik", "accession_number", "form_type", "filing_date", "period_of_report"]
    chunks = parse_filings(docs.select(*meta, "html"), "html", keep=meta, opts=opts)
    stored = docs.select("accession_number").distinct()
    upsert_chunks(spark, index_path, embed(chunks, "text", embedder), date_col="filing_date", filings=stored, opts=opts)
    # One cache row per requesting ticker, and only for filings that are stored:
    # a filing that was not fetched stays marked for ingest in the next run.
    asked = decisions.where(F.col("action") == "ingest").select(
        "ticker_norm", "cik", F.col("fresh_accession_number").alias("accession_number"), F.col("fresh_filing_date").alias("filing_date"),
        F.col("fresh_period_of_report").alias("period_of_report"), F.col("fresh_primary_document").alias("primary_document"),
    ).distinct()
    write_cache(spark, asked.join(stored, "accession_number", "left_semi").select(*CACHE_COLUMNS), cache_path)
    return n_new


def prepare_reports(
    spark: SparkSession,
    decisions: DataFrame,
    index: DataFrame,
    questions: list[str],
    *,
    embedder: Embedder | None = None,
    opts: Options = Options(),
) -> tuple[DataFrame, DataFrame]:
    """The whole request after gating and ingest (C14): for every request
    that has a filing, each question retrieves up to ``retrieve_max_k``
    chunks of that company's chosen filing (ticker and accession filters),
    text cut at ``retrieve_max_chars``; plus the report prompt per request.

    Returns (context rows, prompt rows). Questions are a short fixed list
    expanded per request with ``posexplode`` (no join).
    """
    from filinglens.functions.vectors import hash_embedding
    from filinglens.operators.results import prompt_table
    from filinglens.operators.search import search

    served = decisions.where(F.col("action").isin("serve_cached", "serve_unchanged", "ingest")).select(
        "request_id",
        "ticker_norm",
        F.when(F.col("action") == "serve_cached", F.col("cached_accession_number"))
        .otherwise(F.col("fresh_accession_number"))
        .alias("accession_number"),
    )
    emb = embedder or hash_embedding
    qs = served.select(
        "request_id", "ticker_norm", "accession_number",
        F.posexplode(F.array(*[F.lit(x) for x in questions])).alias("question_no", "question"),
    ).withColumn("query_id", F.col("request_id") * F.lit(len(questions)) + F.col("question_no"))
    queries = qs.select(
        "query_id", emb(F.col("question")).alias("qvec"), F.lit(opts.retrieve_k).alias("k"),
        F.col("ticker_norm").alias("ticker"), "accession_number",
    )
    key = ["accession_number", "section_order", "chunk_index"]
    hits = search(index, queries, opts=opts, key_cols=key, cap=opts.retrieve_max_k)
    ctx = hits.join(index.select(*key, "section_name", "text"), key).join(
        qs.select("query_id", "request_id", "question_no"), "query_id"
    )
    context = ctx.select(
        "request_id", "question_no", "rank", "score", *key, "section_name",
        F.substring("text", 1, opts.retrieve_max_chars).alias("text"),
        (F.char_length("text") > opts.retrieve_max_chars).alias("truncated"),
    )
    prompts = prompt_table(served.select("request_id", "ticker_norm")).select("request_id", "prompt")
    return context, prompts
