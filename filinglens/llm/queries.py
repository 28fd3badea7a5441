"""The ``opN_`` queries: each applies one operator to its whole table. SQL
stands beside those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import align, audit, licenses, mixture, neighbours, pages, pieces, pii, quality, shards, shingle_join, tokens, vector_dedup
from filinglens.sources.tables import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(spark, docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark, read_table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return shards.write_shards(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))[0]


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(spark, read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "pages")
    return pages.main_text(spark, table, pages.train(table))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark, read_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return align.align(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_licenses, op3_shards, op4_mixture, op5_pieces, op6_vector_dedup, op7_shingle_join, op8_token_counts, op9_main_text, op10_neighbours,
              op11_pii, op12_filter_audit, op13_alignment)
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _licenses_sql() -> str:
    """Every window against every template; phrases by their words' places."""
    rows = ", ".join(
        f"({r['template']}, '{r['label']}', {r['step']}, {r['need']}, {len(r['words'])}, {r['words']!r})" for r in licenses.template_rows())
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES)
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), phrase(p, label) AS (VALUES {phrases}),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1 : i + len(p)] = p)) AS pos FROM w, phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id
), t(template, label, step, need, n, words) AS (VALUES {rows}),
blocks AS (
  SELECT doc_id, step, list_distinct(ws[s + 1 : s + 2 * step]) AS block
  FROM (SELECT doc_id, ws, step, unnest(range(0, len(ws), step)) AS s FROM w, (SELECT DISTINCT step FROM t))
), found AS (
  SELECT doc_id, label, len(list_intersect(block, words)) / n AS share
  FROM blocks JOIN t USING (step) WHERE len(list_intersect(block, words)) >= need
), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN more ON w.doc_id = more.doc_id
"""


SQL = {
    "op2_licenses": _licenses_sql(),
    # Shares end at min(2 * size, level * weight): the level follows from the
    # order of 2 * size / weight. One pattern is one source, so the flow takes
    # whole passes and then documents in hash order up to the rest.
    "op4_mixture": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2 * total / weight AS ratio,
    1.5 * sum(total) OVER () - coalesce(sum(2 * total) OVER (ORDER BY 2 * total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY 2 * total / weight DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weights
  FROM s
), level AS (
  SELECT min_by(rest, ratio) AS rest, min_by(weights, ratio) AS weights FROM o WHERE rest / weights < ratio
), goal AS (
  SELECT o.source, o.total,
    CASE WHEN level.rest IS NULL OR 2.0 * o.total <= level.rest * o.weight / level.weights THEN 2.0 * o.total
         ELSE level.rest * o.weight / level.weights END::DOUBLE AS target
  FROM o LEFT JOIN level ON true
), r AS (
  SELECT d.*, total, target, CASE WHEN total = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // total END AS whole,
    CASE WHEN total = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % total END AS part,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, total AS source_size, target,
  CAST(whole * size + least(size, greatest(0, part - before)) AS BIGINT) AS taken
FROM r
""",
    "op7_shingle_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS sh
  FROM w
), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM p JOIN s sx ON x = sx.doc_id JOIN s sy ON y = sy.doc_id WHERE 100 * i >= 85 * (len(sx.sh) + len(sy.sh) - i)
), e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON reach.other = e.x
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id FROM s
""",
    # Every order's steps from the counts of failure combinations.
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN low < doc_id THEN 16 ELSE 0 END AS bits
  FROM w
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, bits
), x(v) AS (VALUES (0), (1), (2), (3), (4)),
o AS (
  SELECT [a.v, b.v, c.v, d.v, e.v] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5
), s AS (
  SELECT array_to_string(list_transform(o, lambda i: chr(65 + i)), '') AS filter_order, step::INTEGER AS step, 1 << o[step] AS own,
    list_sum(list_transform(o[1 : step - 1], lambda i: 1 << i)) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (WHERE bits & (own | coalesce(before, 0)::INTEGER) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE bits & own > 0 AND bits & coalesce(before, 0)::INTEGER = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE bits & own > 0 AND bits & coalesce(before, 0)::INTEGER > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE bits = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE bits & own > 0 AND bits & coalesce(before, 0)::INTEGER = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE bits & own > 0 AND bits & coalesce(before, 0)::INTEGER = 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
""",
}
