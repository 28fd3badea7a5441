"""Analytics on top of the pipeline: ingest metrics and rollups (X8, X9),
growth and trend (X5, X6), facts pivot (X18), change since prior filing
(X7), grounding (X14), topic flags (X16) and retrieval recall (X13).

Money is summed as integer cents so that results do not depend on the
order in which a shuffle delivers the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglens.functions.text import non_blank_lines
from filinglens.operators.joins import spread
from filinglens.operators.sequence import previous_in_group

# ---------------------------------------------------------------------------
# Keyword sets for chunk topic flags
# ---------------------------------------------------------------------------
TOPIC_WORDS = {
    "risk": ("risk", "risks", "uncertain", "uncertainty", "litigation", "lawsuit"),
    "liquidity": ("liquidity", "cash", "debt", "credit", "borrowing"),
    "guidance": ("outlook", "guidance", "expect", "expects", "forecast"),
    "mna": ("acquisition", "merger", "divestiture", "restructuring"),
}
# Whole-word match; a word boundary is any character that is not a letter,
# digit or underscore (Unicode), spelled out so every regex engine agrees.
TOPIC_PATTERNS = {
    k: r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(v) + r")([^\p{L}\p{N}_]|$)" for k, v in TOPIC_WORDS.items()
}

SHINGLE_WORDS = 5
GRAM_CHARS = 4


def cents(col: Column) -> Column:
    return F.round(col * F.lit(100)).cast("long")


def quarter_index(d: Column) -> Column:
    return F.year(d) * 4 + F.quarter(d) - 1


# -- X8 / X9 -----------------------------------------------------------------


def ingest_metrics(chunks: DataFrame, by: list[str], max_chars: int) -> DataFrame:
    """Chunk counts and sizes per group: docs, chunks, avg/max/p95 chars,
    oversize chunks. avg is sum/count over integers, so it is exact."""
    return chunks.groupBy(*by).agg(
        F.countDistinct("doc_id").alias("n_docs"),
        F.count(F.lit(1)).alias("n_chunks"),
        (F.sum("chars").cast("double") / F.count(F.lit(1))).alias("avg_chars"),
        F.max("chars").alias("max_chars"),
        F.round(F.percentile("chars", 0.95), 2).alias("p95_chars"),
        F.sum(F.when(F.col("chars") > max_chars, 1).otherwise(0)).alias("n_oversize"),
    )


def rollup_sizes(df: DataFrame, dims: list[str], size_col: str) -> DataFrame:
    """``rollup`` over dims: count, total and p95 of a size column.

    The p95 of integers interpolates at a position with two decimals, so it
    is rounded to 2 places: the exact value whatever the float evaluation
    order of the interpolation."""
    return df.rollup(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(size_col).alias("total"),
        F.round(F.percentile(size_col, 0.95), 2).alias("p95"),
        F.grouping_id().alias("level"),
    )


# -- X5 / X6 / X18 -------------------------------------------------------------


def quarterly_revenue(facts: DataFrame, entity: str, date_col: str, amount_col: str) -> DataFrame:
    """Revenue in cents per entity and calendar quarter (partial aggregation
    before the shuffle keeps hot entities cheap)."""
    return facts.groupBy(F.col(entity).alias("entity"), quarter_index(F.col(date_col)).alias("qidx")).agg(
        F.sum(cents(F.col(amount_col))).alias("revenue_cents")
    )


def growth(rev: DataFrame) -> DataFrame:
    """QoQ and YoY ratios against the same entity's revenue exactly one and
    four calendar quarters earlier (range frames: a gap gives null)."""
    w = Window.partitionBy("entity").orderBy("qidx")
    prev_q = F.sum("revenue_cents").over(w.rangeBetween(-1, -1))
    prev_y = F.sum("revenue_cents").over(w.rangeBetween(-4, -4))
    out = rev.withColumn("prev_q_cents", prev_q).withColumn("prev_y_cents", prev_y)
    ratio = lambda prev: F.try_divide((F.col("revenue_cents") - F.col(prev)).cast("double"), F.col(prev).cast("double"))
    return out.withColumn("qoq", ratio("prev_q_cents")).withColumn("yoy", ratio("prev_y_cents"))


def trailing(rev: DataFrame, quarters: int = 4) -> DataFrame:
    """Moving average over the last ``quarters`` calendar quarters."""
    w = Window.partitionBy("entity").orderBy("qidx").rangeBetween(-(quarters - 1), 0)
    return rev.withColumn("window_cents", F.sum("revenue_cents").over(w)).withColumn(
        "window_quarters", F.count(F.lit(1)).over(w)
    ).withColumn("trailing_avg", F.col("window_cents").cast("double") / F.col("window_quarters"))


def pivot_facts(facts: DataFrame, row_key: Column, pivot_col: str, values: list[str], amount: Column) -> DataFrame:
    """Sums per row key, one column per value; every other value, null
    included, adds to the column ``other``."""
    value = F.when(F.col(pivot_col).isin(values), F.col(pivot_col)).otherwise(F.lit("other"))
    keyed = facts.select(row_key.alias("row_key"), value.alias("_value"), amount.alias("_amount"))
    return keyed.groupBy("row_key").pivot("_value", [*values, "other"]).agg(F.sum("_amount"))


# -- X7 --------------------------------------------------------------------------


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with an id: the 64-bit hashes of its distinct lines
    (rows of one id count as one document). Rows of a repeated id are gathered
    hash by hash, so equal ones are dropped on the way."""
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    again = docs.groupBy(F.col(id_col).alias("_id")).agg((F.count("*") > 1).alias("_again")).where("_again")
    lines = F.transform(non_blank_lines(F.col(text_col)), lambda x: F.xxhash64(x))
    each = spread(docs, id_col).select(id_col, F.coalesce(F.array_distinct(lines), F.array().cast("array<bigint>")).alias("h"))
    each = each.join(again, F.col(id_col) == F.col("_id"), "left")
    parts = F.when(F.col("_again"), F.transform("h", lambda x: F.array(x))).otherwise(F.array("h"))
    return each.select(id_col, F.explode_outer(parts).alias("h")).groupBy(id_col).agg(F.flatten(F.collect_set("h")).alias("h"))


def changed_since_prior(docs: DataFrame, group_col: str, id_col: str, text_col: str) -> DataFrame:
    """Per document: distinct lines added and removed against the previous
    document of the same group (by id).

    The previous document comes from ``previous_in_group`` (no group is
    sorted inside one task). Only line hashes are shuffled, eight bytes a
    line: a document's array meets its own row and that of its prior, and
    the differences are array functions. Keys are document ids, so neither a
    group nor a line repeated across documents is a hot key.
    """
    pairs = previous_in_group(docs, group_col, id_col).withColumnRenamed("prior", "prior_id")
    h = line_hashes(docs, id_col, text_col)
    cur = h.select(F.col(id_col).alias("_doc"), F.col("h").alias("_cur"))
    prior = h.select(F.col(id_col).alias("_p"), F.col("h").alias("_prior"))
    both = pairs.join(cur, pairs[id_col] == cur["_doc"], "left").join(prior, F.col("prior_id") == F.col("_p"), "left")
    has_prior = F.col("prior_id").isNotNull()
    return both.select(
        group_col,
        id_col,
        "prior_id",
        F.coalesce(F.size("_cur"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(has_prior, F.size(F.array_except("_cur", "_prior"))).cast("long").alias("added"),
        F.when(has_prior, F.size(F.array_except("_prior", "_cur"))).cast("long").alias("removed"),
    )


# -- X14 ---------------------------------------------------------------------------


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != F.lit(""))


def _token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _shingle_hashes(token_hashes: Column, size: int) -> Column:
    """Hash of every run of ``size`` consecutive tokens (from token hashes,
    so no shingle text is built)."""
    n = F.size(token_hashes) - F.lit(size) + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(token_hashes, i, size)))


def _char_grams(text: Column, size: int) -> Column:
    """Hashes of the distinct runs of ``size`` characters (0: one empty run)."""
    if size == 0:
        return F.array(F.xxhash64(F.lit("")))
    n = F.char_length(text) - F.lit(size) + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(size)))))


def grounding(claims: DataFrame, docs: DataFrame, claim_id: str, doc_id: str, text_col: str = "text") -> DataFrame:
    """Which claims occur verbatim in some document, and in how many.

    One plan for any number of claims: each claim picks one key that every
    document with the claim must hold, documents are joined on those keys,
    and every candidate pair is verified on the whole claim text.

    * A claim with >= 3 tokens: its interior tokens are whitespace-bounded
      inside the claim, so they are whole tokens wherever the claim occurs.
      The key is one interior shingle (up to 5 tokens).
    * A shorter claim (no interior token): the key is its first characters
      (up to 4; none for the empty claim, which every document holds).

    A document gives its keys of the sizes in use, cut by a semi join to
    those some claim picked. A null claim is not grounded; a null document
    holds no claim.
    """
    c = claims.select(F.col(claim_id).alias("claim_id"), F.col(text_col).alias("claim"))
    c = c.withColumn("_tok", _tokens(F.col("claim")))
    words = F.least(F.lit(SHINGLE_WORDS), F.size("_tok") - 2)
    chars = F.least(F.lit(GRAM_CHARS), F.char_length("claim"))
    keyed = c.where(F.col("claim").isNotNull()).select(
        "claim_id",
        "claim",
        (F.size("_tok") >= 3).alias("is_words"),
        F.when(F.size("_tok") >= 3, words).otherwise(chars).alias("s"),
        F.when(F.size("_tok") >= 3, F.xxhash64(F.slice(_token_hashes(F.col("_tok")), 2, F.greatest(words, F.lit(1)))))
        .otherwise(F.xxhash64(F.substring(F.col("claim"), F.lit(1), chars)))
        .alias("key"),
    )
    kind = ["is_words", "s", "key"]
    # The sizes in use: at most SHINGLE_WORDS + GRAM_CHARS + 1 rows.
    sizes = sorted(tuple(r) for r in keyed.select("is_words", "s").distinct().collect())
    d = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("doc")).where(F.col("doc").isNotNull()), "doc_id")

    def tagged(is_words, size):
        hashes = (
            F.array_distinct(_shingle_hashes(F.col("dtok"), size)) if is_words else _char_grams(F.col("doc"), size)
        )
        return F.transform(hashes, lambda x: F.struct(F.lit(is_words).alias("is_words"), F.lit(size).alias("s"), x.alias("key")))

    if sizes:
        keys = d.withColumn("dtok", _token_hashes(_tokens(F.col("doc")))).select(
            "doc_id", F.inline(F.concat(*[tagged(w, z) for w, z in sizes]))
        )
        picked = keys.join(keyed.select(*kind).distinct(), kind, "left_semi")
        pairs = picked.join(keyed, kind).select("claim_id", "claim", "doc_id")
        counts = (
            pairs.join(d, "doc_id")
            .where(F.col("doc").contains(F.col("claim")))
            .groupBy("claim_id")
            .agg(F.count_distinct("doc_id").alias("n_docs"))
        )
    else:
        counts = c.select("claim_id").limit(0).withColumn("n_docs", F.lit(0).cast("long"))
    out = c.select("claim_id").join(counts, "claim_id", "left")
    return out.select(
        F.col("claim_id").alias(claim_id),
        (F.coalesce("n_docs", F.lit(0)) > 0).alias("grounded"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
    )


# -- X16 ---------------------------------------------------------------------------


WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def topic_flags(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One boolean per topic: does the text hold one of its words as a
    whole word (any case)? The text is split into words once and each topic
    is an ``arrays_overlap`` test, equal to matching ``TOPIC_PATTERNS``."""
    out = chunks.withColumn("_words", F.split(F.lower(F.col(text_col)), WORD_SPLIT))
    for name, words in TOPIC_WORDS.items():
        out = out.withColumn(f"flag_{name}", F.arrays_overlap("_words", F.array(*[F.lit(w) for w in words])))
    return out.drop("_words")
