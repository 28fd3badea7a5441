"""Registered queries: each maps the fixture tables onto filing roles and
runs one operator over the whole tables.

Roles (see README): customer = company, orders = filing, pages = raw filing
HTML, documents = extracted text, embeddings = chunk vectors (label =
section), benchmark = query / claim text, events = arrivals and JSON
records, lineitem = numeric facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.functions.text import non_blank_lines
from filinglens.functions.vectors import hash_embedding
from filinglens.functions.vectors import norm as _vnorm
from filinglens.operators import ann as _ann
from filinglens.operators import entity as _entity
from filinglens.operators import filings as _filings
from filinglens.operators import gate as _gate
from filinglens.operators import index as _index
from filinglens.operators import ingest as _ingest
from filinglens.operators import metrics as _m
from filinglens.operators import results as _results
from filinglens.operators import sketches as _sketches
from filinglens.operators.chunking import chunk_text, split_sections
from filinglens.operators.embedding import embed, embed_distinct, normalize_vectors
from filinglens.operators.parse import explode_lines, html_to_lines, parse_filings
from filinglens.operators.search import cosine_topk, search
from filinglens.operators.section_rows import sections_of_lines
from filinglens.operators.sequence import global_ranks
from filinglens.operators.temporal import asof_join, points_in_intervals
from filinglens.options import Options
from filinglens.plans import roles
from filinglens.session import scratch_path
from filinglens.sources.filings_json import read_listings, read_ticker_universe
from filinglens.sources.raw_files import read_cache, write_cache
from filinglens.sources.tables import read_table
from filinglens.streaming import ingest as _stream

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

OPTS = Options()


def register(fn: QueryFn) -> QueryFn:
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# Text: HTML → lines → sections → chunks
# ---------------------------------------------------------------------------


@register
def q_html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = html_to_lines(_t(spark, sf_dir, "pages"), "html", keep=["page_id"])
    return explode_lines(lines, ["page_id"]).select(
        "page_id", "line_no", F.char_length("line").alias("chars"), F.md5("line").alias("line_md5")
    )


@register
def q_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = html_to_lines(_t(spark, sf_dir, "pages"), "html", keep=["page_id"], main_text_only=True)
    return explode_lines(lines, ["page_id"]).select(
        "page_id", "line_no", F.char_length("line").alias("chars"), F.md5("line").alias("line_md5")
    )


def _doc_chunks(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_text(docs, "text", OPTS, sep=sep, keep=["doc_id"])


@register
def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_chunks(spark, sf_dir, "\n").select(
        "doc_id", "chunk_index", "chars", "oversize", F.md5("text").alias("chunk_md5")
    )


@register
def q_chunks_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_chunks(spark, sf_dir, "\n\n").select(
        "doc_id", "chunk_index", "chars", "oversize", F.md5("text").alias("chunk_md5")
    )


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------


@register
def q_embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", *[F.col("v")[i].alias(f"e{i}") for i in range(4)])


def _vector_queries(emb: DataFrame, k: int, section_filter: bool) -> DataFrame:
    q = emb.select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("qvec"),
        F.lit(k).alias("k"),
        (F.col("label").cast("string") if section_filter else F.lit(None).cast("string")).alias("section"),
    )
    return q


@register
def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query against all vectors, top 5 by cosine."""
    emb = _t(spark, sf_dir, "embeddings")
    hits = cosine_topk(emb, _vector_queries(emb, 5, False), key_cols=["vec_id"], opts=OPTS)
    return hits.select("query_id", "rank", "vec_id", "score")


@register
def q_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query restricted to its own section (label), top 10."""
    emb = _t(spark, sf_dir, "embeddings").withColumn("section", F.col("label").cast("string"))
    hits = cosine_topk(
        emb, _vector_queries(emb, OPTS.search_k, True), key_cols=["vec_id"], filter_cols=["section"], opts=OPTS
    )
    return hits.select("query_id", "rank", "vec_id", "score")


def page_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages → chunks (sep '\\n', 2000/200) → md5-lane vectors."""
    chunks = parse_filings(_t(spark, sf_dir, "pages"), "html", keep=["page_id"], opts=OPTS)
    return embed(chunks, "text")


def company_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as stored chunks: company by label, section and filing by id."""
    n = F.col("vec_id")
    return _t(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.concat(F.lit("T"), "label").alias("ticker_norm"),
        (F.col("label") % 7).cast("string").alias("cik"),
        F.concat(F.lit("S"), n % 3).alias("section_name"),
        F.concat(F.lit("A"), n % 20).alias("accession_number"),
    )


@register
def q_search_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query through ``search``: by ticker (any case),
    CIK, section, filing, ticker and section, or nothing; filters that are
    off are null or empty; k is negative, 0 or above the cap for some."""
    n = F.col("vec_id")
    turn = n % 6
    queries = _t(spark, sf_dir, "embeddings").select(
        n.alias("query_id"),
        F.col("embedding").alias("qvec"),
        F.when(n % 9 == 0, F.lit(-1)).otherwise(n % 13).alias("k"),
        F.when(turn.isin(1, 5), F.concat(F.lit(" t"), "label")).alias("ticker"),
        F.when(turn == 2, (F.col("label") % 7).cast("string")).otherwise(F.lit("")).alias("cik"),
        F.when(turn.isin(3, 5), F.concat(F.lit("S"), n % 4)).alias("section_name"),
        F.when(turn == 4, F.concat(F.lit("A"), n % 20)).alias("accession_number"),
    )
    return search(company_index(spark, sf_dir), queries, key_cols=["vec_id"], cap=OPTS.search_k, opts=OPTS)


PAGE_KEY = ["page_id", "section_order", "chunk_index"]


def _stored_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once and written to the shared folder, as an ingest run would;
    the search scan and the join back both read the written table."""
    path = scratch_path(spark, "page-index")
    page_chunk_index(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text asks for 20 chunks."""
    return _t(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        hash_embedding(F.col("text")).alias("qvec"),
        F.lit(OPTS.retrieve_k).alias("k"),
    )


def _context_rows(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with their text cut at 1,500 characters."""
    ctx = hits.join(index.select(*PAGE_KEY, "section_name", "text", "chars"), PAGE_KEY)
    cut = F.substring("text", 1, OPTS.retrieve_max_chars)
    return ctx.select(
        "query_id",
        "rank",
        *PAGE_KEY,
        "section_name",
        "score",
        F.col("chars").alias("full_chars"),
        (F.col("chars") > OPTS.retrieve_max_chars).alias("truncated"),
        F.md5(cut).alias("context_md5"),
    )


@register
def q_retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page corpus; the tool caps k at 5."""
    index = _stored_page_index(spark, sf_dir)
    hits = search(index, _benchmark_queries(spark, sf_dir), key_cols=PAGE_KEY, cap=OPTS.retrieve_max_k, opts=OPTS)
    return _context_rows(hits, index)


@register
def q_retrieve_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the tool is called: only chunks of the asked company (pages and
    questions belong to one of eight)."""

    def company(c):
        return F.concat(F.lit("T"), F.col(c) % 8)

    index = _stored_page_index(spark, sf_dir).withColumn("ticker_norm", company("page_id"))
    queries = _benchmark_queries(spark, sf_dir).withColumn("ticker", F.lower(company("query_id")))
    hits = search(index, queries, key_cols=PAGE_KEY, cap=OPTS.retrieve_max_k, opts=OPTS)
    return _context_rows(hits, index)


# ---------------------------------------------------------------------------
# Companies and filings
# ---------------------------------------------------------------------------

FILING_OUT = list(_filings.FILING_COLS)


def _entity_dim(spark, sf_dir):
    return _entity.build_entity_dim(roles.universe(spark, sf_dir))


@register
def q_entity_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_dim(spark, sf_dir)


@register
def q_resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _entity.resolve_tickers(roles.requests(spark, sf_dir), _entity_dim(spark, sf_dir))
    return r.select("request_id", "ticker", "ticker_norm", "cik", "company_name", "status")


LISTING_PAGE = 1000


def _listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings regrouped into listing pages of at most 1,000 filings per
    company (parallel arrays; pages whose first filing is in December carry
    no periodOfReport array)."""
    f = roles.filings(spark, sf_dir).withColumn("page", (F.col("pos") / LISTING_PAGE).cast("long"))
    g = f.groupBy("cik", "page").agg(
        F.sort_array(
            F.collect_list(
                F.struct("pos", "form_type", "filing_date", "accession_number", "primary_document", "period_of_report")
            )
        ).alias("fs"),
        F.min("filing_date").alias("first_date"),
    )
    iso = "yyyy-MM-dd"
    return g.select(
        "cik",
        "page",
        F.transform("fs", lambda x: x["form_type"]).alias("form"),
        F.transform("fs", lambda x: F.date_format(x["filing_date"], iso)).alias("filingDate"),
        F.transform("fs", lambda x: x["accession_number"]).alias("accessionNumber"),
        F.transform("fs", lambda x: x["primary_document"]).alias("primaryDocument"),
        F.when(
            F.month("first_date") != 12,
            F.transform("fs", lambda x: F.coalesce(F.date_format(x["period_of_report"], iso), F.lit(""))),
        ).alias("periodOfReport"),
    )


@register
def q_unzip_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings regrouped into listing pages of at most 1,000 filings per
    company (parallel arrays; pages whose first filing is in December carry
    no periodOfReport array), then unzipped."""
    listing = _listing_pages(spark, sf_dir)
    return _filings.unzip_listing(listing, keep=["cik", "page"]).select(
        "cik", "page", F.col("pos").cast("int").alias("pos"), "form_type", "filing_date",
        "accession_number", "primary_document", "period_of_report",
    )


@register
def q_universe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies written as universe files and read back in splits."""
    folder = scratch_path(spark, "universe")
    roles.write_universe_json(spark, sf_dir, folder)
    return read_ticker_universe(spark, folder).select("pos", "cik_str", "ticker", "title")


@register
def q_listings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages written as JSON, a document a line, and read back: the
    first ticker of a list (none for every seventh company), dates from text."""
    listed = _listing_pages(spark, sf_dir)
    number = F.col("cik").cast("long")
    recent = F.struct(*_filings.LISTING_ARRAYS)
    document = F.struct(
        "cik", F.lit("operating").alias("entityType"), F.when(number % 5 != 0, F.lit("3571")).alias("sic"), F.concat(F.lit('"Co", {'), "cik").alias("name"),
        F.when(number % 7 != 0, F.array(F.concat(F.lit("T"), number.cast("string")), F.lit("OLD"))).alias("tickers"), F.struct(recent.alias("recent")).alias("filings"))
    folder = scratch_path(spark, "listings")
    listed.select(F.to_json(document).alias("value")).write.text(folder)
    return read_listings(spark, folder, lines=True).select(
        "cik", "entity_type", "sic", "company_name", "ticker", "form_type", "filing_date", "accession_number", "primary_document", "period_of_report")


@register
def q_latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings.select_latest(roles.filings(spark, sf_dir), OPTS).select(*FILING_OUT)


@register
def q_filing_for_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings.select_latest(roles.filings(spark, sf_dir), OPTS, target_period=roles.TARGET_PERIOD).select(
        *FILING_OUT
    )


@register
def q_latest_filing_amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings.select_latest_amended(roles.filings(spark, sf_dir), OPTS).select(*FILING_OUT)


@register
def q_recent_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _filings.recent_filings(roles.filings(spark, sf_dir), 3, OPTS)
    return r.select("cik", "recent_rank", "accession_number", "filing_date", "form_type")


@register
def q_filing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _filings.filing_paths(roles.filings(spark, sf_dir))
    return p.select("accession_number", "archive_url", "storage_path")


@register
def q_pending_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest filing per company whose landing path is not among the
    landed files (fulfilled orders stand for landed filings)."""
    f = roles.filings(spark, sf_dir)
    wanted = _filings.filing_paths(_filings.select_latest(f, OPTS))
    landed = _filings.filing_paths(f.where(F.col("status") == roles.LANDED_STATUS))
    return _filings.pending_downloads(wanted, landed).select("cik", "accession_number", "storage_path")


def _index_keys(f: DataFrame) -> DataFrame:
    """Chunk-index keys: filings of fulfilled orders count as ingested."""
    return f.where(F.col("status") == roles.STORED_STATUS).select(
        F.col("ticker").alias("ticker_norm"), "cik", "accession_number"
    )


@register
def q_has_accession(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = roles.filings(spark, sf_dir)
    req = _filings.select_latest(f, OPTS).select("cik", F.col("ticker").alias("ticker_norm"), "accession_number")
    return _gate.has_accession(req, _index_keys(f))


def _cache_for(f: DataFrame, entity: DataFrame, cond) -> DataFrame:
    latest = _filings.select_latest(f.where(cond), OPTS)
    return latest.join(entity.select(F.col("ticker").alias("ticker_norm"), "cik"), "cik")


@register
def q_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = roles.filings(spark, sf_dir)
    ent = _entity_dim(spark, sf_dir)
    cache = _cache_for(f, ent, F.col("filing_date") < F.to_date(F.lit(roles.CACHE_CUT_DATE)))
    keys = _gate.stored_keys(_index_keys(f), "cik")
    g = _gate.gate(roles.requests(spark, sf_dir), ent, cache, f, keys, OPTS)
    return g.select(
        "request_id", "ticker_norm", "cik", "status", "action", "cached_accession_number", "fresh_accession_number"
    )


@register
def q_latest_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = roles.filings(spark, sf_dir)
    ent = _entity_dim(spark, sf_dir)
    cut = F.to_date(F.lit(roles.CACHE_CUT_DATE))
    old = _cache_for(f, ent, F.col("filing_date") < cut)
    batch = _cache_for(f, ent, F.col("filing_date") >= cut)
    return _gate.merge_latest_cache(old, batch)


@register
def q_asof_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest filing of its company known when each request arrived."""
    known = roles.filings(spark, sf_dir).withColumn("filed", roles.filed_at())
    joined = asof_join(roles.arrivals(spark, sf_dir), known, by="cik", left_time="arrived", right_time="filed", carry=["filed", "accession_number", "form_type"])
    return joined.select("event_id", "cik", "accession_number", "form_type", (F.col("arrived") - F.col("filed")).alias("age_seconds"))


@register
def q_valid_at_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with every filing of their company that holds when they
    arrive: a year, a quarter, a month or a day, by form."""
    days = F.lit(None).cast("long")
    for form, n in roles.HOLDS_DAYS.items():
        days = F.when(F.col("form_type") == form, F.lit(n).cast("long")).otherwise(days)
    held = roles.filings(spark, sf_dir).select("cik", "accession_number", roles.filed_at().alias("begins"), (roles.filed_at() + days * 86_400).alias("ends"))
    met = points_in_intervals(roles.arrivals(spark, sf_dir), held, by="cik", time="arrived", start="begins", end="ends", width=86_400)
    return met.select("event_id", "accession_number", (F.col("arrived") - F.col("begins")).alias("age_seconds"))


@register
def q_reconcile_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed filings against stored ones, some of which are stored twice,
    not at all, or under a number that no listing has."""
    f = roles.filings(spark, sf_dir)
    stored = f.where("pos % 3 <> 0").select("cik", "accession_number")
    twice = f.where("pos % 5 = 0").select("cik", "accession_number")
    unlisted = f.where("pos % 7 = 0").select("cik", F.concat(F.lit("X"), "accession_number").alias("accession_number"))
    return _gate.reconcile(f, stored.unionAll(twice).unionAll(unlisted), ["cik", "accession_number"])


@register
def q_filing_size_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, percent rank and decile of every document by its length."""
    return global_ranks(_t(spark, sf_dir, "documents"), "doc_id", "n_chars", 10)


# ---------------------------------------------------------------------------
# Sections, vector variants, analytics
# ---------------------------------------------------------------------------


def with_generated_headings(text):
    """Insert ``Item n. Part X`` heading lines into a text, driven by each
    line's md5: a heading before the line ('0'-'3' in the second hex digit),
    a heading replacing the line ('f'), an 'A' item suffix ('a'/'b' first)."""

    def gen(x, i):
        h = F.md5(x)
        head = F.concat(
            F.lit("Item "),
            (i + 1).cast("string"),
            F.when(F.substring(h, 1, 1).isin("a", "b"), F.lit("A")).otherwise(F.lit("")),
            F.lit(". Part "),
            F.upper(F.substring(h, 3, 1)),
        )
        c = F.substring(h, 2, 1)
        return (
            F.when(c.isin("0", "1", "2", "3"), F.array(head, x))
            .when(c == "f", F.array(head))
            .otherwise(F.array(x))
        )

    return F.array_join(F.flatten(F.transform(F.split(text, "\n"), gen)), "\n")


@register
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", non_blank_lines(with_generated_headings(F.col("text"))).alias("lines"))
    s = split_sections(docs, "lines", OPTS, keep=["doc_id"])
    return s.select(
        "doc_id", "section_order", "section_item", "section_name",
        F.char_length("text").alias("chars"), F.md5("text").alias("text_md5"),
    )


@register
def q_sections_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sections``, from a table of lines."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", non_blank_lines(with_generated_headings(F.col("text"))).alias("lines"))
    s = sections_of_lines(explode_lines(docs, ["doc_id"]), "doc_id", OPTS)
    return s.select(
        "doc_id", "section_order", "section_item", "section_name",
        F.char_length("text").alias("chars"), F.md5("text").alias("text_md5"),
    )


@register
def q_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embed_distinct(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return v.select("doc_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(4)])


@register
def q_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = normalize_vectors(_t(spark, sf_dir, "embeddings"), "embedding", "unit")
    return v.select("vec_id", _vnorm(F.col("unit")).alias("unit_norm"), F.posexplode("unit").alias("pos", "component"))


@register
def q_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each vector's 10 nearest neighbours carrying its label."""
    emb = _t(spark, sf_dir, "embeddings")
    hits = cosine_topk(emb, _vector_queries(emb, OPTS.search_k, False), key_cols=["vec_id"], opts=OPTS)
    lab = emb.select("vec_id", "label")
    j = hits.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    return j.groupBy("query_id", "qlabel").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum((F.col("label") == F.col("qlabel")).cast("int")).alias("n_same")
    ).withColumnRenamed("qlabel", "label")


ANN_RECALL = 0.95


@register
def q_ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query against an inverted-list index of all vectors,
    built by two upserts that overlap (the second run twice): its best hit,
    and whether the ten hits of all queries reach the wanted recall."""
    stored = company_index(spark, sf_dir).withColumn("accession_number", F.concat("accession_number", F.lit("-"), (F.col("vec_id") / 100).cast("long")))
    path = scratch_path(spark, "ann")
    part = F.substring_index(F.substring("accession_number", 2, 99), "-", 1).cast("int")
    _ann.upsert_ann(spark, path, stored.where(part < 15), opts=OPTS)
    for _ in range(2):
        _ann.upsert_ann(spark, path, stored.where(part >= 10), opts=OPTS)
    probes = _ann.fit_probes(spark, path, key_cols=["vec_id"], k=OPTS.search_k, opts=OPTS)
    queries = _vector_queries(stored.select("vec_id", "embedding", F.lit(0).alias("label")), OPTS.search_k, False)
    out = scratch_path(spark, "ann-hits")
    _ann.ann_topk(spark, path, queries, key_cols=["vec_id"], probes=probes, opts=OPTS).write.parquet(out)
    hits = spark.read.parquet(out)
    true = cosine_topk(stored, queries, key_cols=["vec_id"], opts=OPTS).select("query_id", "vec_id")
    met = true.join(hits.select("query_id", "vec_id", F.lit(1).alias("_found")), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("_found", F.lit(0))).alias("r")).first()
    return hits.where("rank = 1").select("query_id", F.col("vec_id").alias("top_id"), F.col("score").alias("top_score"), F.lit(met["r"] is None or met["r"] >= ANN_RECALL).alias("recall_reached"))


@register
def q_ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    chunks = chunk_text(docs, "text", OPTS, keep=["doc_id", "lang"])
    return _m.ingest_metrics(chunks, ["lang"], OPTS.max_chars)


@register
def q_ingest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m.rollup_sizes(_t(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


def _company_revenue(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return _m.quarterly_revenue(o, "o_custkey", "o_orderdate", "o_totalprice")


@register
def q_quarterly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m.growth(_company_revenue(spark, sf_dir))


@register
def q_trailing_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m.trailing(_company_revenue(spark, sf_dir), 4)


@register
def q_facts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    amount = _m.cents(F.col("l_extendedprice")) * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("long"))
    return _m.pivot_facts(li, _m.quarter_index(F.col("l_shipdate")), "l_returnflag", ["A", "N", "R"], amount)


@register
def q_changed_since_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m.changed_since_prior(_t(spark, sf_dir, "documents"), "source", "doc_id", "text")


@register
def q_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m.grounding(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"), "item_id", "doc_id")


@register
def q_chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _m.topic_flags(_doc_chunks(spark, sf_dir, "\n"))
    return f.select("doc_id", "chunk_index", *[f"flag_{k}" for k in _m.TOPIC_PATTERNS])


# ---------------------------------------------------------------------------
# Index upsert, prompts, results
# ---------------------------------------------------------------------------

# Every document is in a batch, and most of the second batch is not in the first.
UPSERT_LATER_LANGS = ("fr", "es")
UPSERT_STABLE_LANG = "en"
UPSERT_SECOND_OPTS = Options(max_chars=1000, overlap_chars=100)


def _doc_index_batch(spark, sf_dir, tag: str, in_batch, opts: Options) -> DataFrame:
    """Documents as filings: accession = doc id, company = source."""
    docs = _t(spark, sf_dir, "documents").where(in_batch).select(
        F.col("doc_id").cast("string").alias("accession_number"),
        F.col("source").alias("cik"),
        F.upper("source").alias("ticker_norm"),
        F.lit(0).alias("section_order"),
        F.lit("Unknown").alias("section_name"),
        "text",
    )
    chunks = chunk_text(docs, "text", opts, keep=["accession_number", "cik", "ticker_norm", "section_order", "section_name"])
    return embed(chunks, "text").withColumn("batch", F.lit(tag))


@register
def q_upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a first batch, then upsert an overlapping re-chunked batch
    twice (the second run must change nothing); read the index back."""
    path = scratch_path(spark, "chunk-index")
    lang = F.coalesce("lang", F.lit(""))
    _index.upsert_chunks(
        spark, path, _doc_index_batch(spark, sf_dir, "first", ~lang.isin(*UPSERT_LATER_LANGS), OPTS), opts=OPTS
    )
    second = _doc_index_batch(spark, sf_dir, "second", lang != UPSERT_STABLE_LANG, UPSERT_SECOND_OPTS)
    _index.upsert_chunks(spark, path, second, opts=OPTS)
    _index.upsert_chunks(spark, path, second, opts=OPTS)
    idx = _index.read_index(spark, path)
    return idx.select(
        F.col("accession_number").cast("long").alias("doc_id"), "chunk_index", "chars",
        F.md5("text").alias("chunk_md5"), "batch",
    )


@register
def q_stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents by company, some of which move to another
    company with a second batch; then every document and as many unknown ones are looked up
    by key. Found ones carry the company they are stored with."""
    docs = _t(spark, sf_dir, "documents")
    moved = F.coalesce("lang", F.lit("")).isin(*UPSERT_LATER_LANGS)
    path = scratch_path(spark, "lookup-index")
    rows = [F.col("doc_id").cast("string").alias("accession_number"), F.md5(F.coalesce("text", F.lit(""))).alias("text")]
    _index.upsert_chunks(spark, path, docs.select(F.coalesce("source", F.lit("")).alias("cik"), *rows), opts=OPTS)
    _index.upsert_chunks(spark, path, docs.where(moved).select(F.concat(F.lit("m-"), "lang").alias("cik"), *rows), opts=OPTS)
    known = docs.select(F.col("doc_id").cast("string").alias("accession_number"))
    asked = known.unionAll(known.select(F.concat("accession_number", F.lit("-x"))))
    found = _index.stored_among(spark, path, asked, opts=OPTS)
    return asked.join(found, "accession_number", "left").select("accession_number", F.col("cik").alias("company"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str, int, int]:
    """A whole ingest: the universe from JSON files, the gate against a
    cache of earlier filings and an empty index, landing, parsing, index, cache; then
    the same requests once more. Decisions of both runs, the index, and how many filings each landed."""
    at = scratch_path(spark, "request")
    paths = {"landing_path": f"{at}/landing", "index_path": f"{at}/index", "cache_path": f"{at}/cache"}
    roles.write_universe_json(spark, sf_dir, f"{at}/universe")
    entity = _entity.build_entity_dim(read_ticker_universe(spark, f"{at}/universe"))
    filings, requests = roles.filings(spark, sf_dir), roles.requests(spark, sf_dir)
    cut = F.to_date(F.lit(roles.CACHE_CUT_DATE))
    write_cache(spark, _cache_for(filings, entity, F.col("filing_date") < cut), paths["cache_path"])
    runs, landed = [], []
    for _ in range(2):
        decisions = _gate.gate_with_index(spark, requests, entity, read_cache(spark, paths["cache_path"]), filings, paths["index_path"], OPTS)
        wanted = _ingest.filings_to_ingest(decisions).select("accession_number")
        archive = _filings.filing_paths(filings.join(wanted, "accession_number", "left_semi"))
        landed.append(_ingest.run_ingest(spark, decisions, roles.fetched(spark, sf_dir, archive), **paths, opts=OPTS))
        runs.append(decisions)
    return *runs, paths["index_path"], *landed


@register
def q_ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request before and after an ingest run, with what is stored of its filing."""
    first, second, path, landed, again = _ingested(spark, sf_dir)
    stored = _index.read_index(spark, path).groupBy("accession_number").agg(F.count("*").alias("n_chunks"), F.sum("chars").cast("long").alias("chars"))
    second = second.select(
        "request_id", F.col("action").alias("second_action"), F.col("cached_accession_number").alias("second_cached"), F.col("fresh_accession_number").alias("accession_number"))
    both = first.select("request_id", F.col("action").alias("first_action"), F.col("cached_accession_number").alias("first_cached")).join(second, "request_id")
    return both.join(stored, "accession_number", "left").select(
        "request_id", "first_action", "first_cached", "second_action", "second_cached", "accession_number", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        "chars", F.lit(landed).cast("long").alias("landed"), F.lit(again).cast("long").alias("landed_again"))


@register
def q_report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After an ingest run, the context of every request's fixed questions."""
    _, decisions, path, _, _ = _ingested(spark, sf_dir)
    context, _ = _ingest.prepare_reports(spark, decisions, _index.read_index(spark, path), list(roles.QUESTIONS), opts=OPTS)
    return context.select(
        "request_id", "question_no", "rank", "score", "accession_number", "section_order", "chunk_index", "section_name", "truncated", F.md5("text").alias("context_md5"))


@register
def q_prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    req = c.select(
        F.col("c_custkey").alias("request_id"),
        _entity.normalize_ticker(roles.raw_ticker(seg, F.col("c_nationkey"))).alias("ticker_norm"),
        F.when(seg == "BUILDING", F.lit(None)).when(seg == "AUTOMOBILE", F.lit("")).otherwise(
            F.concat(F.lit("Segment "), seg, F.lit(" leader"))
        ).alias("thesis"),
        F.when(seg == "MACHINERY", F.lit("")).otherwise(F.lit(None)).alias("goal"),
    )
    p = _results.prompt_table(req)
    return p.select("request_id", "ticker_norm", F.char_length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@register
def q_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _filings.select_latest(roles.filings(spark, sf_dir), OPTS)
    summary = F.concat(
        F.col("company_name"), F.lit(" filed "), F.col("form_type"), F.lit(" on "), F.date_format("filing_date", "yyyy-MM-dd")
    )
    j = latest.select("cik", _results.to_json_keep_nulls(_results.insights_struct(F.lit(None).cast("string"), summary)).alias("insights_json"))
    return j.withColumn("decision_prompt_md5", F.md5(_results.decision_prompt(F.col("insights_json"))))


def decision_records(events: DataFrame) -> DataFrame:
    """Decision replies as JSON text derived from events, with every kind
    of defect: missing fields, a text confidence, values out of range or
    out of the enum, and truncated (malformed) text."""
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    number = F.concat((cents / 1000).cast("long").cast("string"), F.lit("."), F.lpad((cents % 1000).cast("string"), 3, "0"))
    conf = (
        F.when(et == "error", F.lit('"high"'))
        .when(k % 10 == 6, F.concat(F.lit('"'), number, F.lit('"')))
        .otherwise(number)
    )
    decision = (
        F.when(et == "purchase", F.lit('"decision":"buy",'))
        .when(et == "view", F.lit('"decision":"hold",'))
        .when(et == "signup", F.lit('"decision":"sell",'))
        .when(et == "click", F.lit('"decision":"strong buy",'))
        .otherwise(F.lit(""))
    )
    body = F.concat(
        F.lit("{"), decision, F.lit('"confidence":'), conf, F.lit(","),
        F.when(k < 10, F.lit("")).when(k % 10 == 7, F.lit('"time_horizon":5,')).otherwise(
            F.lit('"time_horizon":"6-12 months",')
        ),
        F.when(k % 10 == 3, F.lit('"positives":"oops",'))
        .when(k % 10 == 4, F.lit('"positives":["a",null],'))
        .otherwise(F.concat(F.lit('"positives":["'), et, F.lit('"],'))),
        F.lit('"negatives":[],'),
        F.when(et == "view", F.lit("")).otherwise(F.lit('"uncertainties":[],')),
        F.lit('"risk_profile":"moderate"'),
        F.when(k % 10 == 5, F.lit(',"disclaimer":null')).when(k >= 50, F.lit(',"disclaimer":"custom"')).otherwise(F.lit("")),
    )
    return events.select("event_id", F.when(k >= 95, body).otherwise(F.concat(body, F.lit("}"))).alias("json"))


@register
def q_validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _results.validate_decisions(decision_records(_t(spark, sf_dir, "events")), "json")
    return v.drop("json")


@register
def q_validate_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One insights reply per company, most with one defect."""
    c = _t(spark, sf_dir, "customer")
    text = F.replace(
        F.replace(F.lit(roles.INSIGHTS_REPLY), F.lit("@name"), F.col("c_name")), F.lit("@cik"), F.col("c_custkey").cast("string")
    )
    n = F.col("c_custkey") % (len(roles.INSIGHTS_DEFECTS) + 2)
    reply = text
    for i, (old, new) in enumerate(roles.INSIGHTS_DEFECTS, 2):
        reply = F.when(n == i, F.replace(text, F.lit(old), F.lit(new))).otherwise(reply)
    reply = F.when(n == 1, F.left(text, F.lit(200))).otherwise(reply)
    v = _results.validate_insights(c.select(F.col("c_custkey").alias("record_id"), reply.alias("json")), "json")
    return v.drop("json")


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------


def url_host(col: str):
    return F.regexp_extract(F.col(col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)


@register
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive as files; the stream parses, embeds and upserts them;
    the index then equals the batch chunking of all pages."""
    schema = _t(spark, sf_dir, "pages").schema
    pages = _stream.file_stream(spark, sf_dir, "pages.parquet", schema).withColumn("company", url_host("url"))
    path = scratch_path(spark, "stream-index")
    _stream.stream_ingest(spark, pages, path, company_col="company", opts=OPTS)
    idx = _index.read_index(spark, path)
    return idx.select("page_id", "section_order", "chunk_index", "chars", F.md5("text").alias("chunk_md5"))


@register
def q_stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _t(spark, sf_dir, "events").schema
    events = _stream.file_stream(spark, sf_dir, "events.parquet", schema)
    path = scratch_path(spark, "hourly")
    _stream.stream_hourly_counts(spark, events, path)
    out = spark.read.parquet(path)
    return out.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", "value_cents"
    )


@register
def q_stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events arrive twice, the copies in later micro-batches."""
    events = _t(spark, sf_dir, "events")
    folder = scratch_path(spark, "arrivals")
    events.write.parquet(folder)
    n = len(spark.read.parquet(folder).inputFiles())
    events.write.mode("append").parquet(folder)
    out = scratch_path(spark, "distinct")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", n).parquet(folder)
    _stream.stream_distinct(spark, stream, out, key=["event_id"], time_col="ts", delay="40 days")
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("value_cents"))


@register
def q_stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, the earlier half of the time first; hours the watermark closed."""
    events = _t(spark, sf_dir, "events")
    folder = scratch_path(spark, "arrivals")
    ends = events.agg(F.min("ts").cast("timestamp").cast("double").alias("lo"), F.max("ts").cast("timestamp").cast("double").alias("hi")).first()
    middle = ((ends["lo"] or 0.0) + (ends["hi"] or 0.0)) / 2
    early = F.col("ts").cast("timestamp").cast("double") <= middle
    events.where(early).write.parquet(folder)
    n = len(spark.read.parquet(folder).inputFiles())
    events.where(~early).write.mode("append").parquet(folder)
    out = scratch_path(spark, "closed")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(n, 1)).parquet(folder)
    _stream.stream_closed_windows(spark, stream, out)
    return spark.read.parquet(out).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", "value_cents")


@register
def q_summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in three batches that leave summaries only; the cube
    over them is held against exact figures of all documents: distinct texts
    within 5 % (three standard errors), quantiles within 1 %."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    path, dims, percents = scratch_path(spark, "summaries"), ["lang", "source"], {"p50": 50, "p95": 95}
    for i in range(3):
        _sketches.append_summaries(docs.where(F.pmod("doc_id", F.lit(3)) == i), path, batch=str(i), dims=dims, distinct_col="h", value_col="n_chars")
    told = _sketches.cube_of_summaries(*_sketches.read_summaries(spark, path), dims, percents)
    sizes = _sketches.grouped(docs.where("n_chars IS NOT NULL"), dims, ["n_chars"], F.count(F.lit(1)).alias("n"))
    ranks = _sketches.at_ranks(sizes, dims, "n_chars", percents)
    exact = _sketches.grouped(docs, dims, [], F.countDistinct("h").alias("exact_distinct"))

    def beside(left: DataFrame, right: DataFrame, tag: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"{tag}_{c}") for c in right.columns])
        return left.join(right, F.expr(" AND ".join(f"{c} <=> {tag}_{c}" for c in ("level", *dims))))

    both = beside(beside(told, ranks, "r"), exact, "x")
    near = lambda a, b, share: F.abs(F.col(a) - F.col(b)) <= F.col(b) * F.lit(share + 1e-9)
    return both.select(
        *dims, F.col("level").cast("long").alias("level"), "n", "total", F.col("x_exact_distinct").alias("exact_distinct"), F.col("r_p50").cast("long").alias("exact_p50"),
        F.col("r_p95").cast("long").alias("exact_p95"), near("n_distinct", "x_exact_distinct", 0.05).alias("distinct_near"),
        (near("p50", "r_p50", 0.01) & near("p95", "r_p95", 0.01)).alias("quantiles_near"))
