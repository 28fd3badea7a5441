"""DuckDB SQL that states each registered query independently.

Used by the correctness gate: the same fixture tables are pre-registered as
views. Fragments below spell out the text rules (Python strip / splitlines,
HTML chain, chunk fold) in DuckDB's list functions and RE2 regexes.
"""

from __future__ import annotations

from filinglens.functions.text import HTML_ENTITIES, PY_WHITESPACE
from filinglens.operators.metrics import TOPIC_PATTERNS
from filinglens.options import ARCHIVES_BASE as R_ARCHIVES
from filinglens.options import DISCLAIMER_DEFAULT, GOAL_DEFAULT, THESIS_DEFAULT, Options
from filinglens.plans import roles as R
from filinglens.templates import DECISION_PROMPT_PREFIX, INSIGHTS_PROMPT_TEMPLATE

O = Options()

# Python str.isspace() characters as a DuckDB string expression.
WS = "(" + "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
NL = "chr(10)"
NL2 = "(chr(10)||chr(10))"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
UWS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEADING = r"(?i)^item" + UWS + r"+(\p{Nd}+[A-Z]?)\." + UWS + r"*(.+)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def lines(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, {q(LINE_BREAK)}), lambda l: {strip('l')}), "
        "lambda l: l <> '')"
    )


def html_text(h: str, main_only: bool = False) -> str:
    out = h
    if main_only:
        for tag in ("nav", "header", "footer", "aside"):
            out = f"regexp_replace({out}, {q(rf'(?is)<{tag}\b[^>]*>.*?</{tag}\s*>')}, {NL}, 'g')"
        ad = r"""(?is)<div\b[^>]*\bclass\s*=\s*["']?ad["']?[^>]*>.*?</div\s*>"""
        out = f"regexp_replace({out}, {q(ad)}, {NL}, 'g')"
    out = f"regexp_replace({out}, {q(r'(?s)<!--.*?(?:-->|$)')}, {NL}, 'g')"
    for tag in ("script", "style", "template"):
        out = f"regexp_replace({out}, {q(rf'(?is)<{tag}\b[^>]*>(?:.*?</{tag}\s*>|.*)')}, {NL}, 'g')"
    out = f"regexp_replace({out}, {q(r'<[!?][^>]*>')}, {NL}, 'g')"
    tag_re = r"""</?[A-Za-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
    out = f"regexp_replace({out}, {q(tag_re)}, {NL}, 'g')"
    for ent, ch in HTML_ENTITIES:
        out = f"replace({out}, {q(ent)}, chr({ord(ch)}))"
    return f"replace({out}, '&amp;', '&')"


def paragraphs(x: str, sep: str) -> str:
    sep_sql = NL if sep == "\n" else NL2
    return f"list_filter(list_transform(string_split({x}, {sep_sql}), lambda p: {strip('p')}), lambda p: p <> '')"


def chunk_list(x: str, sep: str, max_chars: int = O.max_chars, overlap: int = O.overlap_chars) -> str:
    """The greedy paragraph fold as list_reduce over a struct state."""
    carried = f"right(a.cur, {overlap}) || {NL2} || p.cur" if overlap > 0 else "p.cur"
    step = (
        f"CASE WHEN length(a.cur) + length(p.cur) + 2 > {max_chars} AND a.cur <> '' "
        f"THEN {{'cur': {carried}, 'out': list_append(a.out, {strip('a.cur')})}} "
        f"ELSE {{'cur': CASE WHEN a.cur <> '' THEN a.cur || {NL2} || p.cur ELSE p.cur END, 'out': a.out}} END"
    )
    init = "{'cur': '', 'out': []::VARCHAR[]}"
    red = (
        f"list_reduce(list_transform({paragraphs(x, sep)}, lambda p: {{'cur': p, 'out': []::VARCHAR[]}}), "
        f"lambda a, p: {step}, {init})"
    )
    return f"(SELECT CASE WHEN s.cur <> '' THEN list_append(s.out, {strip('s.cur')}) ELSE s.out END FROM (SELECT {red} AS s))"


def md5_lane(text: str, i: int) -> str:
    return f"CAST(('0x' || substring(md5({text}), {1 + 4 * i}, 4))::INTEGER AS DOUBLE)"


def hash_vec(text: str) -> str:
    return "[" + ", ".join(md5_lane(text, i) for i in range(4)) + "]"


def cosine(a: str, b: str) -> str:
    dot = f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1] * z[2], 0.0::DOUBLE)), lambda x, y: x + y, 0.0::DOUBLE)"
    na = f"sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda x, y: x + y, 0.0::DOUBLE))"
    nb = f"sqrt(list_reduce(list_transform({b}, lambda x: x * x), lambda x, y: x + y, 0.0::DOUBLE))"
    return f"({dot}) / (({na}) * ({nb}) + 1e-9)"


ORACLE: dict[str, str] = {}


def sql(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn

    return deco


@sql("html_lines")
def _():
    return f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(length(ls[i]) AS INTEGER) AS chars, md5(ls[i]) AS line_md5
FROM (SELECT page_id, {lines(html_text('html'))} AS ls FROM pages) t, range(1, len(ls) + 1) r(i)
"""


@sql("html_main_text")
def _():
    return f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(length(ls[i]) AS INTEGER) AS chars, md5(ls[i]) AS line_md5
FROM (SELECT page_id, {lines(html_text('html', True))} AS ls FROM pages) t, range(1, len(ls) + 1) r(i)
"""


def _chunks_sql(sep: str) -> str:
    return f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(length(cs[i]) AS INTEGER) AS chars,
       length(cs[i]) > {O.max_chars} AS oversize, md5(cs[i]) AS chunk_md5
FROM (SELECT doc_id, {chunk_list('text', sep)} AS cs FROM documents) t, range(1, len(cs) + 1) r(i)
"""


@sql("chunks")
def _():
    return _chunks_sql("\n")


@sql("chunks_faithful")
def _():
    return _chunks_sql("\n\n")


@sql("embed_hash")
def _():
    return "SELECT doc_id, " + ", ".join(f"{md5_lane('text', i)} AS e{i}" for i in range(4)) + " FROM documents"


@sql("cosine_topk")
def _():
    return f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, s.score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c,
       LATERAL (SELECT {cosine('CAST(q.embedding AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS score) s
) WHERE rank <= 5
"""


@sql("search_filtered")
def _():
    return f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, s.score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.label = c.label,
       LATERAL (SELECT {cosine('CAST(q.embedding AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS score) s
) WHERE rank <= {O.search_k}
"""


@sql("search_by_company")
def _():
    return f"""
WITH idx AS (
  SELECT vec_id, embedding, 'T' || label AS ticker_norm, CAST(label % 7 AS VARCHAR) AS cik, 'S' || (vec_id % 3) AS section_name,
         'A' || (vec_id % 20) AS accession_number FROM embeddings
), qs AS (
  SELECT vec_id AS query_id, embedding AS qvec, least(CASE WHEN vec_id % 9 = 0 THEN -1 ELSE vec_id % 13 END, {O.search_k}) AS k,
         CASE WHEN vec_id % 6 IN (1, 5) THEN 'T' || label END AS ticker_norm,
         CASE vec_id % 6 WHEN 2 THEN CAST(label % 7 AS VARCHAR) END AS cik,
         CASE WHEN vec_id % 6 IN (3, 5) THEN 'S' || (vec_id % 4) END AS section_name,
         CASE vec_id % 6 WHEN 4 THEN 'A' || (vec_id % 20) END AS accession_number
  FROM embeddings
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, k, c.vec_id, s.score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, c.vec_id) AS rank
  FROM qs, idx c, LATERAL (SELECT {cosine('CAST(qs.qvec AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS score) s
  WHERE coalesce(qs.ticker_norm = c.ticker_norm, true) AND coalesce(qs.cik = c.cik, true)
    AND coalesce(qs.section_name = c.section_name, true) AND coalesce(qs.accession_number = c.accession_number, true)
) WHERE rank <= k
"""


def page_chunks_sql() -> str:
    """pages → lines → one 'Unknown' section per page (pages carry no Item
    headings; the general split is exercised by the ``sections`` query) →
    chunks with vectors."""
    return f"""
page_lines AS (SELECT page_id, {lines(html_text('html'))} AS ls FROM pages),
page_sections AS (
  SELECT page_id, 0 AS section_order, 'Unknown' AS section_name, array_to_string(ls, chr(10)) AS text
  FROM page_lines WHERE len(ls) > 0
),
page_chunk_lists AS (SELECT page_id, section_order, section_name, {chunk_list('text', chr(10))} AS cs FROM page_sections),
page_chunks AS (
  SELECT page_id, section_order, section_name, CAST(i - 1 AS INTEGER) AS chunk_index, cs[i] AS text,
         CAST(length(cs[i]) AS INTEGER) AS chars
  FROM page_chunk_lists, range(1, len(cs) + 1) r(i)
),
page_index AS (SELECT *, {hash_vec('text')} AS embedding FROM page_chunks)
"""


def _context(same_company: str) -> str:
    return f"""
WITH {page_chunks_sql()},
qs AS (SELECT item_id AS query_id, {hash_vec('text')} AS qvec FROM benchmark),
scored AS (
  SELECT qs.query_id, c.page_id, c.section_order, c.chunk_index, c.section_name, c.text, c.chars,
         {cosine('qs.qvec', 'c.embedding')} AS score
  FROM qs, page_index c WHERE {same_company}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id, section_order, chunk_index) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, page_id, CAST(section_order AS INTEGER) AS section_order, chunk_index,
       section_name, score, chars AS full_chars, chars > {O.retrieve_max_chars} AS truncated,
       md5(substring(text, 1, {O.retrieve_max_chars})) AS context_md5
FROM ranked WHERE rank <= least(greatest({O.retrieve_k}, 0), {O.retrieve_max_k})
"""


@sql("retrieve_context")
def _():
    return _context("true")


@sql("retrieve_by_company")
def _():
    return _context("qs.query_id % 8 = c.page_id % 8")


# ---------------------------------------------------------------------------
# Companies and filings (roles as in plans/roles.py)
# ---------------------------------------------------------------------------


def _raw_ticker(seg: str, nation: str) -> str:
    return f"(' ' || lower(substring({seg}, 1, 4)) || CAST({nation} AS VARCHAR))"


def _norm_ticker(x: str) -> str:
    return f"upper({strip(x)})"


FORM_CASE = "CASE o_orderpriority " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in R.FORM_BY_PRIORITY.items()
) + " END"

ROLES_CTE = f"""
universe AS (
  SELECT c_custkey AS pos, CAST(c_custkey AS VARCHAR) AS cik_str,
         {_raw_ticker('c_mktsegment', 'c_nationkey')} AS ticker, c_name AS title FROM customer
),
entity AS (
  SELECT ticker_norm AS ticker, printf('%010d', arg_max(cik_int, pos)) AS cik, arg_max(cik_int, pos) AS cik_int,
         arg_max(title, pos) AS company_name
  FROM (SELECT pos, {_norm_ticker('ticker')} AS ticker_norm, TRY_CAST(cik_str AS BIGINT) AS cik_int, title FROM universe)
  GROUP BY ticker_norm
),
filings AS (
  SELECT o_orderkey AS pos, printf('%010d', o_custkey) AS cik, {FORM_CASE} AS form_type,
         CAST(o_orderdate AS DATE) AS filing_date,
         CASE WHEN o_orderstatus <> 'P'
              THEN last_day(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) - INTERVAL 1 MONTH AS DATE)) END
           AS period_of_report,
         printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey) AS accession_number,
         'doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primary_document,
         o_orderstatus AS status,
         {_norm_ticker(_raw_ticker('c_mktsegment', 'c_nationkey'))} AS ticker,
         c_name AS company_name
  FROM orders JOIN customer ON o_custkey = c_custkey
),
requests AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_acctbal < 0 THEN 'x' || upper({_raw_ticker('c_mktsegment', 'c_nationkey')})
              ELSE upper({_raw_ticker('c_mktsegment', 'c_nationkey')}) END AS ticker,
         CASE WHEN c_mktsegment = {q(R.TARGET_SEGMENT)} THEN DATE {q(R.TARGET_PERIOD)} END AS filing_period,
         c_mktsegment = {q(R.FORCE_SEGMENT)} AS force_refresh
  FROM customer
),
quarterly AS (SELECT * FROM filings WHERE form_type IN ('10-Q', '10-Q/A'))
"""

FILING_SEL = "ticker, cik, company_name, form_type, filing_date, period_of_report, accession_number, primary_document"


def _latest(src: str, part: str = "cik", order: str = "filing_date DESC, pos") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS _rn FROM {src}) WHERE _rn = 1)"


@sql("entity_dim")
def _():
    return f"WITH {ROLES_CTE} SELECT * FROM entity"


@sql("resolve_requests")
def _():
    return f"""WITH {ROLES_CTE}
SELECT r.request_id, r.ticker, {_norm_ticker('r.ticker')} AS ticker_norm, e.cik, e.company_name,
       CASE WHEN e.cik IS NULL THEN 'unknown_ticker' ELSE 'ok' END AS status
FROM requests r LEFT JOIN entity e ON {_norm_ticker('r.ticker')} = e.ticker"""


@sql("unzip_parallel_arrays")
def _():
    return f"""WITH {ROLES_CTE}, paged AS (SELECT *, pos // 1000 AS page FROM filings)
SELECT cik, page,
       CAST(row_number() OVER (PARTITION BY cik, page ORDER BY pos) - 1 AS INTEGER) AS pos,
       form_type, filing_date, accession_number, primary_document,
       CASE WHEN month(min(filing_date) OVER (PARTITION BY cik, page)) = 12 THEN NULL ELSE period_of_report END
         AS period_of_report
FROM paged"""


@sql("universe_json")
def _():
    n = R.UNIVERSE_FILE_ENTRIES
    odd = f"(c_custkey // {n}) % 2 = 1 AND c_custkey % 50 = 7"
    return f"""
SELECT c_custkey AS pos, CAST(c_custkey AS VARCHAR) AS cik_str, {_raw_ticker('c_mktsegment', 'c_nationkey')} AS ticker,
       c_name || CASE WHEN {odd} THEN ' {{a}},"1":{{b}}' ELSE '' END AS title
FROM customer"""


@sql("listings_json")
def _():
    return f"""WITH {ROLES_CTE}, paged AS (SELECT *, pos // 1000 AS page, CAST(cik AS BIGINT) AS number FROM filings)
SELECT cik, 'operating' AS entity_type, CASE WHEN number % 5 <> 0 THEN '3571' END AS sic, '"Co", {{' || cik AS company_name,
       CASE WHEN number % 7 <> 0 THEN 'T' || number ELSE '' END AS ticker, form_type, filing_date, accession_number, primary_document,
       CASE WHEN month(min(filing_date) OVER (PARTITION BY cik, page)) = 12 THEN NULL ELSE period_of_report END
         AS period_of_report
FROM paged"""


@sql("latest_filing")
def _():
    return f"WITH {ROLES_CTE} SELECT {FILING_SEL} FROM {_latest('quarterly')}"


@sql("filing_for_period")
def _():
    return f"""WITH {ROLES_CTE}, t AS (SELECT * FROM quarterly WHERE period_of_report = DATE {q(R.TARGET_PERIOD)})
SELECT {FILING_SEL} FROM {_latest('t')}"""


@sql("latest_filing_amended")
def _():
    order = "filing_date DESC, CASE WHEN form_type = '10-Q/A' THEN 1 ELSE 0 END DESC, pos"
    return f"WITH {ROLES_CTE} SELECT {FILING_SEL} FROM {_latest('quarterly', order=order)}"


@sql("recent_filings")
def _():
    return f"""WITH {ROLES_CTE}
SELECT cik, CAST(recent_rank AS INTEGER) AS recent_rank, accession_number, filing_date, form_type FROM (
  SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, pos) AS recent_rank FROM quarterly
) WHERE recent_rank <= 3"""


def _paths(src: str) -> str:
    url = (
        f"{q(R_ARCHIVES)} || '/' || regexp_replace(cik, '^0+', '') || '/' || replace(accession_number, '-', '') "
        "|| '/' || primary_document"
    )
    path = "'filings/' || ticker || '/' || cik || '/' || form_type || '/' || accession_number || '/' || primary_document"
    return f"(SELECT *, {url} AS archive_url, {path} AS storage_path FROM {src})"


@sql("filing_paths")
def _():
    return f"WITH {ROLES_CTE} SELECT accession_number, archive_url, storage_path FROM {_paths('filings')}"


@sql("pending_downloads")
def _():
    return f"""WITH {ROLES_CTE},
wanted AS {_paths(_latest('quarterly'))},
landed AS {_paths(f"(SELECT * FROM filings WHERE status = {q(R.LANDED_STATUS)})")}
SELECT cik, accession_number, storage_path FROM wanted
WHERE storage_path NOT IN (SELECT storage_path FROM landed)"""


STORED_CTE = f"stored AS (SELECT DISTINCT ticker AS ticker_norm, cik, accession_number FROM filings WHERE status = {q(R.STORED_STATUS)})"


@sql("has_accession")
def _():
    return f"""WITH {ROLES_CTE}, {STORED_CTE}
SELECT l.cik, l.ticker AS ticker_norm, l.accession_number FROM {_latest('quarterly')} l
WHERE EXISTS (SELECT 1 FROM stored s WHERE s.ticker_norm = l.ticker AND s.accession_number = l.accession_number)"""


def _cache_cte(name: str, cond: str) -> str:
    return f"""{name} AS (
  SELECT e.ticker AS ticker_norm, l.cik, l.accession_number, l.filing_date, l.period_of_report, l.primary_document
  FROM {_latest(f"(SELECT * FROM quarterly WHERE {cond})")} l JOIN entity e ON l.cik = e.cik
)"""


@sql("gate_decision")
def _():
    cut = f"DATE {q(R.CACHE_CUT_DATE)}"
    return f"""WITH {ROLES_CTE}, {STORED_CTE}, {_cache_cte('cache', f'filing_date < {cut}')},
latest_any AS {_latest('quarterly')},
latest_period AS {_latest('(SELECT * FROM quarterly WHERE period_of_report IS NOT NULL)', part='cik, period_of_report')},
r AS (
  SELECT r.request_id, {_norm_ticker('r.ticker')} AS ticker_norm, e.cik,
         CASE WHEN e.cik IS NULL THEN 'unknown_ticker' ELSE 'ok' END AS status,
         r.filing_period, coalesce(r.force_refresh, false) AS force_refresh,
         c.cik AS cached_cik, c.accession_number AS cached_accession_number, c.filing_date AS cached_filing_date,
         c.period_of_report AS cached_period_of_report,
         CASE WHEN r.filing_period IS NULL THEN la.accession_number ELSE lp.accession_number END AS fresh_accession_number,
         CASE WHEN r.filing_period IS NULL THEN la.filing_date ELSE lp.filing_date END AS fresh_filing_date,
         CASE WHEN r.filing_period IS NULL THEN la.period_of_report ELSE lp.period_of_report END AS fresh_period_of_report
  FROM requests r
  LEFT JOIN entity e ON {_norm_ticker('r.ticker')} = e.ticker
  LEFT JOIN cache c ON {_norm_ticker('r.ticker')} = c.ticker_norm
  LEFT JOIN latest_any la ON la.cik = e.cik AND r.filing_period IS NULL
  LEFT JOIN latest_period lp ON lp.cik = e.cik AND lp.period_of_report = r.filing_period
),
f AS (
  SELECT r.*,
    EXISTS (SELECT 1 FROM stored s WHERE s.cik = r.cached_cik AND s.accession_number = r.cached_accession_number) AS cached_stored,
    EXISTS (SELECT 1 FROM stored s WHERE s.cik = r.cik AND s.accession_number = r.fresh_accession_number) AS fresh_stored
  FROM r
)
SELECT request_id, ticker_norm, cik, status,
  CASE
    WHEN cached_accession_number IS NOT NULL AND NOT force_refresh
         AND (filing_period IS NULL OR filing_period = cached_period_of_report) AND cached_stored THEN 'serve_cached'
    WHEN cik IS NULL THEN 'unknown_ticker'
    WHEN fresh_accession_number IS NULL THEN 'no_filing'
    WHEN cached_accession_number IS NOT NULL AND NOT force_refresh AND cached_filing_date = fresh_filing_date
         AND cached_period_of_report IS NOT DISTINCT FROM fresh_period_of_report AND fresh_stored THEN 'serve_unchanged'
    ELSE 'ingest' END AS action,
  cached_accession_number, fresh_accession_number
FROM f"""


@sql("latest_cache_merge")
def _():
    cut = f"DATE {q(R.CACHE_CUT_DATE)}"
    return f"""WITH {ROLES_CTE}, {_cache_cte('old', f'filing_date < {cut}')}, {_cache_cte('batch', f'filing_date >= {cut}')},
both_ AS (SELECT * FROM old UNION ALL SELECT * FROM batch)
SELECT ticker_norm, cik, accession_number, filing_date, period_of_report, primary_document
FROM {_latest('both_', part='ticker_norm', order='filing_date DESC, accession_number DESC')}"""


# ---------------------------------------------------------------------------
# Sections, vector variants, analytics
# ---------------------------------------------------------------------------


def _head(x: str, i: str) -> str:
    return (
        f"'Item ' || CAST({i} AS VARCHAR) || CASE WHEN substring(md5({x}), 1, 1) IN ('a', 'b') THEN 'A' ELSE '' END "
        f"|| '. Part ' || upper(substring(md5({x}), 3, 1))"
    )


@sql("sections")
def _():
    gen = (
        f"list_transform(string_split(text, chr(10)), lambda x, i: CASE "
        f"WHEN substring(md5(x), 2, 1) IN ('0', '1', '2', '3') THEN [{_head('x', 'i')}, x] "
        f"WHEN substring(md5(x), 2, 1) = 'f' THEN [{_head('x', 'i')}] ELSE [x] END)"
    )
    return f"""
WITH g AS (SELECT doc_id, {lines(f"array_to_string(flatten({gen}), chr(10))")} AS ls FROM documents),
s AS (
  SELECT doc_id, ls, list_concat([-1], list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, {q(HEADING)}) THEN i - 1 ELSE -1 END), lambda j: j >= 0)) AS st
  FROM g
),
secs AS (
  SELECT doc_id, list_filter(list_transform(st, lambda b, k: {{
      'item': CASE WHEN b < 0 THEN NULL ELSE regexp_extract(ls[b + 1], {q(HEADING)}, 1) END,
      'name': CASE WHEN b < 0 THEN 'Unknown' ELSE regexp_extract(ls[b + 1], {q(HEADING)}, 2) END,
      'body': list_slice(ls, b + 2, coalesce(st[k + 1], len(ls)))}}), lambda z: len(z.body) > 0) AS sv
  FROM s
)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_order, sv[i].item AS section_item, sv[i].name AS section_name,
       CAST(length(array_to_string(sv[i].body, chr(10))) AS INTEGER) AS chars,
       md5(array_to_string(sv[i].body, chr(10))) AS text_md5
FROM secs, range(1, len(sv) + 1) r(i)
"""


ORACLE["sections_from_lines"] = ORACLE["sections"]


ORACLE["embed_dedup"] = ORACLE["embed_hash"]


@sql("l2_normalize")
def _():
    v = "CAST(embedding AS DOUBLE[])"
    n = f"sqrt(list_reduce(list_transform({v}, lambda x: x * x), lambda x, y: x + y, 0.0::DOUBLE))"
    return f"""
WITH u AS (SELECT vec_id, CASE WHEN {n} > 0 THEN list_transform({v}, lambda x: x / {n}) ELSE {v} END AS unit FROM embeddings)
SELECT vec_id, sqrt(list_reduce(list_transform(unit, lambda x: x * x), lambda x, y: x + y, 0.0::DOUBLE)) AS unit_norm,
       CAST(i - 1 AS INTEGER) AS pos, unit[i] AS component
FROM u, range(1, len(unit) + 1) r(i)"""


@sql("recall_at_k")
def _():
    return f"""
WITH hits AS (
  SELECT * FROM (
    SELECT q.vec_id AS query_id, q.label AS qlabel, c.label,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, c.vec_id) AS rank
    FROM embeddings q, embeddings c,
         LATERAL (SELECT {cosine('CAST(q.embedding AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS score) s
  ) WHERE rank <= {O.search_k}
)
SELECT query_id, qlabel AS label, count(*) AS n_hits, CAST(sum(CASE WHEN label = qlabel THEN 1 ELSE 0 END) AS BIGINT) AS n_same
FROM hits GROUP BY query_id, qlabel"""


DOC_CHUNKS_CTE = f"""
doc_chunk_lists AS (SELECT doc_id, lang, {chunk_list('text', chr(10))} AS cs FROM documents),
doc_chunks AS (
  SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS chunk_index, cs[i] AS text, CAST(length(cs[i]) AS INTEGER) AS chars
  FROM doc_chunk_lists, range(1, len(cs) + 1) r(i)
)"""


@sql("ingest_metrics")
def _():
    return f"""WITH {DOC_CHUNKS_CTE}
SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, CAST(sum(chars) AS DOUBLE) / count(*) AS avg_chars,
       max(chars) AS max_chars, round(quantile_cont(chars, 0.95), 2) AS p95_chars,
       CAST(sum(CASE WHEN chars > {O.max_chars} THEN 1 ELSE 0 END) AS BIGINT) AS n_oversize
FROM doc_chunks GROUP BY lang"""


@sql("ingest_rollup")
def _():
    return """
SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(quantile_cont(n_chars, 0.95), 2) AS p95,
       CAST(GROUPING(lang, source) AS BIGINT) AS level
FROM documents GROUP BY ROLLUP (lang, source)"""


REV_CTE = """
rev AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS qidx,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
  FROM orders GROUP BY ALL
)"""


@sql("quarterly_growth")
def _():
    return f"""WITH {REV_CTE},
w AS (
  SELECT *, CAST(sum(revenue_cents) OVER (PARTITION BY entity ORDER BY qidx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS BIGINT) AS prev_q_cents,
            CAST(sum(revenue_cents) OVER (PARTITION BY entity ORDER BY qidx RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS BIGINT) AS prev_y_cents
  FROM rev
)
SELECT entity, qidx, revenue_cents, prev_q_cents, prev_y_cents,
       CAST(revenue_cents - prev_q_cents AS DOUBLE) / CAST(prev_q_cents AS DOUBLE) AS qoq,
       CAST(revenue_cents - prev_y_cents AS DOUBLE) / CAST(prev_y_cents AS DOUBLE) AS yoy
FROM w"""


@sql("trailing_trend")
def _():
    return f"""WITH {REV_CTE},
w AS (
  SELECT *, CAST(sum(revenue_cents) OVER (PARTITION BY entity ORDER BY qidx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_cents,
            count(*) OVER (PARTITION BY entity ORDER BY qidx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS window_quarters
  FROM rev
)
SELECT entity, qidx, revenue_cents, window_cents, window_quarters,
       CAST(window_cents AS DOUBLE) / window_quarters AS trailing_avg
FROM w"""


@sql("facts_pivot")
def _():
    amt = "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))"
    cols = ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{v}' THEN {amt} END) AS BIGINT) AS \"{v}\"" for v in ("A", "N", "R"))
    cols += f", CAST(sum(CASE WHEN coalesce(l_returnflag, '') NOT IN ('A', 'N', 'R') THEN {amt} END) AS BIGINT) AS other"
    return f"""
SELECT CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS row_key, {cols}
FROM lineitem GROUP BY 1"""


@sql("changed_since_prior")
def _():
    return f"""
WITH h AS (SELECT DISTINCT doc_id, md5(unnest({lines('text')})) AS h FROM documents),
p AS (SELECT source, doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prior_id FROM documents),
n AS (SELECT doc_id, count(*) AS n_lines FROM h GROUP BY doc_id)
SELECT p.source, p.doc_id, p.prior_id, coalesce(n.n_lines, 0) AS n_lines,
  CASE WHEN p.prior_id IS NULL THEN NULL ELSE
    (SELECT count(*) FROM h c WHERE c.doc_id = p.doc_id AND NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = p.prior_id AND o.h = c.h)) END AS added,
  CASE WHEN p.prior_id IS NULL THEN NULL ELSE
    (SELECT count(*) FROM h o WHERE o.doc_id = p.prior_id AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = p.doc_id AND c.h = o.h)) END AS removed
FROM p LEFT JOIN n ON n.doc_id = p.doc_id"""


@sql("grounding")
def _():
    return """
SELECT b.item_id, count(d.doc_id) > 0 AS grounded, count(d.doc_id) AS n_docs
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)
GROUP BY b.item_id"""


@sql("chunk_flags")
def _():
    flags = ", ".join(f"regexp_matches(text, {q(p)}) AS flag_{k}" for k, p in TOPIC_PATTERNS.items())
    return f"WITH {DOC_CHUNKS_CTE} SELECT doc_id, chunk_index, {flags} FROM doc_chunks"


# ---------------------------------------------------------------------------
# Index upsert, prompts, results
# ---------------------------------------------------------------------------


@sql("upsert_chunks")
def _():
    def part(tag, in_batch, mx, ov):
        return f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(length(cs[i]) AS INTEGER) AS chars, md5(cs[i]) AS chunk_md5, {q(tag)} AS batch
FROM (SELECT doc_id, {chunk_list('text', chr(10), mx, ov)} AS cs FROM documents WHERE {in_batch}) t,
     range(1, len(cs) + 1) r(i)"""

    kept = part("first", "lang = 'en'", O.max_chars, O.overlap_chars)
    replaced = part("second", "lang IS DISTINCT FROM 'en'", 1000, 100)
    return f"{kept} UNION ALL {replaced}"


@sql("stored_lookup")
def _():
    later = ", ".join(q(x) for x in ("fr", "es"))
    return f"""
SELECT CAST(doc_id AS VARCHAR) AS accession_number, CASE WHEN lang IN ({later}) THEN 'm-' || lang ELSE coalesce(source, '') END AS company FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '-x', NULL FROM documents"""


def _gate_run(n: int, cache: str, stored: str) -> str:
    """CTEs r{n}, d{n}: the gate's decisions against a cache and stored filings."""
    return f"""
r{n} AS (
  SELECT r.request_id, {_norm_ticker('r.ticker')} AS ticker_norm, e.cik, r.filing_period, coalesce(r.force_refresh, false) AS force_refresh,
         c.accession_number AS cached_accession_number, c.filing_date AS cached_filing_date, c.period_of_report AS cached_period_of_report,
         f.accession_number AS fresh_accession_number, f.filing_date AS fresh_filing_date, f.period_of_report AS fresh_period_of_report,
         f.primary_document AS fresh_primary_document,
         EXISTS (SELECT 1 FROM {stored} s WHERE s.cik = c.cik AND s.accession_number = c.accession_number) AS cached_stored,
         EXISTS (SELECT 1 FROM {stored} s WHERE s.cik = e.cik AND s.accession_number = f.accession_number) AS fresh_stored
  FROM requests r
  LEFT JOIN entity e ON {_norm_ticker('r.ticker')} = e.ticker
  LEFT JOIN {cache} c ON {_norm_ticker('r.ticker')} = c.ticker_norm
  LEFT JOIN latest_both f ON f.cik = e.cik AND f.asked IS NOT DISTINCT FROM r.filing_period
),
d{n} AS (
  SELECT *, CASE
    WHEN cached_accession_number IS NOT NULL AND NOT force_refresh
         AND (filing_period IS NULL OR filing_period = cached_period_of_report) AND cached_stored THEN 'serve_cached'
    WHEN cik IS NULL THEN 'unknown_ticker'
    WHEN fresh_accession_number IS NULL THEN 'no_filing'
    WHEN cached_accession_number IS NOT NULL AND NOT force_refresh AND cached_filing_date = fresh_filing_date
         AND cached_period_of_report IS NOT DISTINCT FROM fresh_period_of_report AND fresh_stored THEN 'serve_unchanged'
    ELSE 'ingest' END AS action FROM r{n}
)"""


def _ingest_ctes() -> str:
    """Both runs: d1, d2; got (filings landed, with their page); stored (those with chunks)."""
    return f"""WITH {ROLES_CTE}, {_cache_cte('cache0', f'filing_date < DATE {q(R.CACHE_CUT_DATE)}')}, {page_chunks_sql()},
latest_both AS (
  SELECT *, NULL::DATE AS asked FROM {_latest('quarterly')}
  UNION ALL SELECT *, period_of_report AS asked FROM {_latest('(SELECT * FROM quarterly WHERE period_of_report IS NOT NULL)', part='cik, period_of_report')}
),
nothing AS (SELECT '' AS cik, '' AS accession_number WHERE false),
{_gate_run(1, 'cache0', 'nothing')},
got AS (
  SELECT DISTINCT d.ticker_norm, d.cik, f.accession_number, f.filing_date, f.period_of_report, f.primary_document, p.page_id
  FROM d1 d JOIN filings f ON f.accession_number = d.fresh_accession_number
  JOIN pages p ON p.page_id = f.pos % (SELECT max(page_id) + 1 FROM pages)
  WHERE d.action = 'ingest' AND f.status <> 'P' AND p.html IS NOT NULL
),
stored AS (SELECT * FROM got WHERE page_id IN (SELECT page_id FROM page_chunks)),
both_caches AS (SELECT * FROM cache0 UNION ALL SELECT ticker_norm, cik, accession_number, filing_date, period_of_report, primary_document FROM got),
cache1 AS (SELECT * EXCLUDE (_rn) FROM {_latest('both_caches', part='ticker_norm', order='filing_date DESC, accession_number DESC')}),
{_gate_run(2, 'cache1', 'stored')}"""


@sql("ingest_run")
def _():
    return f"""{_ingest_ctes()},
sizes AS (SELECT accession_number, count(*) AS n_chunks, CAST(sum(chars) AS BIGINT) AS chars FROM stored JOIN page_chunks USING (page_id) GROUP BY 1)
SELECT request_id, d1.action AS first_action, d1.cached_accession_number AS first_cached, d2.action AS second_action,
       d2.cached_accession_number AS second_cached, d2.fresh_accession_number AS accession_number, coalesce(n_chunks, 0) AS n_chunks, chars,
       (SELECT count(*) FROM got) AS landed, CAST(0 AS BIGINT) AS landed_again
FROM d1 JOIN d2 USING (request_id) LEFT JOIN sizes ON sizes.accession_number = d2.fresh_accession_number"""


@sql("report_context")
def _():
    asked = ", ".join(f"({i}, {q(text)})" for i, text in enumerate(R.QUESTIONS))
    return f"""{_ingest_ctes()},
questions AS (SELECT CAST(no AS INTEGER) AS question_no, {hash_vec('question')} AS qvec FROM (VALUES {asked}) v(no, question)),
served AS (
  SELECT request_id, ticker_norm, CASE WHEN action = 'serve_cached' THEN cached_accession_number ELSE fresh_accession_number END AS accession_number
  FROM d2 WHERE action IN ('serve_cached', 'serve_unchanged', 'ingest')
),
scored AS (
  SELECT page_id, section_order, chunk_index, section_name, text, question_no, chars, {cosine('questions.qvec', 'c.embedding')} AS score
  FROM questions, page_index c
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, question_no ORDER BY score DESC, section_order, chunk_index) AS rank
  FROM served JOIN stored USING (ticker_norm, accession_number) JOIN scored USING (page_id)
)
SELECT request_id, question_no, CAST(rank AS INTEGER) AS rank, score, accession_number, CAST(section_order AS INTEGER) AS section_order, chunk_index, section_name,
       chars > {O.retrieve_max_chars} AS truncated, md5(substring(text, 1, {O.retrieve_max_chars})) AS context_md5
FROM ranked WHERE rank <= least({O.retrieve_k}, {O.retrieve_max_k})"""


def _prompt_sql(ticker: str, thesis: str, goal: str) -> str:
    parts = []
    rest = INSIGHTS_PROMPT_TEMPLATE
    for ph in ("{ticker}", "{thesis}", "{goal}"):
        head, rest = rest.split(ph, 1)
        parts.append(head)
    parts.append(rest)
    return (
        f"{q(parts[0])} || {ticker} || {q(parts[1])} || coalesce(nullif({thesis}, ''), {q(THESIS_DEFAULT)}) || "
        f"{q(parts[2])} || coalesce(nullif({goal}, ''), {q(GOAL_DEFAULT)}) || {q(parts[3])}"
    )


@sql("prompt_table")
def _():
    return f"""
WITH r AS (
  SELECT c_custkey AS request_id, {_norm_ticker(_raw_ticker('c_mktsegment', 'c_nationkey'))} AS ticker_norm,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'AUTOMOBILE' THEN ''
              ELSE 'Segment ' || c_mktsegment || ' leader' END AS thesis,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE NULL END AS goal
  FROM customer
), p AS (SELECT request_id, ticker_norm, {_prompt_sql('ticker_norm', 'thesis', 'goal')} AS prompt FROM r)
SELECT request_id, ticker_norm, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM p"""


@sql("response_json")
def _():
    empty_map = "MAP {}::MAP(VARCHAR, DOUBLE)"
    rec = f"""{{
  'company_profile': {{'name': company_name, 'ticker': ticker, 'cik': cik, 'sector': NULL::VARCHAR, 'industry': NULL::VARCHAR}},
  'filing_metadata': {{'ticker': ticker, 'cik': cik, 'company_name': company_name, 'form_type': form_type,
      'filing_date': filing_date, 'period_of_report': period_of_report, 'accession_number': accession_number,
      'primary_document': primary_document, 'xbrl_instance_document': NULL::VARCHAR}},
  'high_level_summary': company_name || ' filed ' || form_type || ' on ' || strftime(filing_date, '%Y-%m-%d'),
  'financial_summary': {{'key_metrics': {empty_map}, 'narrative': ''}},
  'risk_summary': []::STRUCT(title VARCHAR, description VARCHAR, changed_since_prior BOOLEAN)[],
  'notable_events': []::STRUCT(category VARCHAR, summary VARCHAR)[],
  'liquidity_and_capital_structure': {{'narrative': '', 'leverage_metrics': {empty_map}}},
  'guidance_and_outlook': {{'narrative': '', 'time_horizon': NULL::VARCHAR}},
  'open_questions': []::VARCHAR[]
}}"""
    return f"""WITH {ROLES_CTE}, j AS (SELECT cik, CAST(to_json({rec}) AS VARCHAR) AS insights_json FROM {_latest('quarterly')})
SELECT cik, insights_json, md5({q(DECISION_PROMPT_PREFIX)} || insights_json) AS decision_prompt_md5 FROM j"""


@sql("validate_records")
def _():
    k = "CAST(json_extract(props, '$.k') AS INTEGER)"
    cents = "CAST(round(value * 100) AS BIGINT)"
    number = f"CAST({cents} // 1000 AS VARCHAR) || '.' || lpad(CAST({cents} % 1000 AS VARCHAR), 3, '0')"
    conf = f"""CASE WHEN event_type = 'error' THEN '"high"' WHEN {k} % 10 = 6 THEN '"' || {number} || '"' ELSE {number} END"""
    dec = """CASE event_type WHEN 'purchase' THEN '"decision":"buy",' WHEN 'view' THEN '"decision":"hold",'
      WHEN 'signup' THEN '"decision":"sell",' WHEN 'click' THEN '"decision":"strong buy",' ELSE '' END"""
    body = f"""'{{' || {dec} || '"confidence":' || {conf} || ',' ||
      CASE WHEN {k} < 10 THEN '' WHEN {k} % 10 = 7 THEN '"time_horizon":5,' ELSE '"time_horizon":"6-12 months",' END ||
      CASE {k} % 10 WHEN 3 THEN '"positives":"oops",' WHEN 4 THEN '"positives":["a",null],'
        ELSE '"positives":["' || event_type || '"],' END || '"negatives":[],' ||
      CASE WHEN event_type = 'view' THEN '' ELSE '"uncertainties":[],' END ||
      '"risk_profile":"moderate"' || CASE WHEN {k} % 10 = 5 THEN ',"disclaimer":null' WHEN {k} >= 50 THEN ',"disclaimer":"custom"' ELSE '' END"""
    conf_num = "try_cast(json_extract_string(json, '$.confidence') AS DOUBLE)"
    checks = []
    for f in ("decision", "confidence", "time_horizon", "positives", "negatives", "uncertainties", "risk_profile", "disclaimer"):
        if f == "confidence":
            ok = f"json_type(json, '$.confidence') <> 'NULL' AND {conf_num} IS NOT NULL"
        elif f in ("positives", "negatives", "uncertainties"):
            ok = f"json_type(json, '$.{f}') = 'ARRAY' AND NOT list_contains(json_type(json, ['$.{f}[0]', '$.{f}[1]']), 'NULL')"
        else:
            ok = f"json_type(json, '$.{f}') = 'VARCHAR'"
        if f == "disclaimer":
            checks.append(f"CASE WHEN json_type(json, '$.{f}') IS NOT NULL AND NOT ({ok}) THEN 'type:{f}' END")
        else:
            checks.append(f"CASE WHEN json_type(json, '$.{f}') IS NULL THEN 'missing:{f}' WHEN NOT ({ok}) THEN 'type:{f}' END")
    checks += [
        "CASE WHEN dec IS NOT NULL AND dec NOT IN ('buy', 'sell', 'hold') THEN 'enum:decision' END",
        "CASE WHEN conf IS NOT NULL AND NOT (conf BETWEEN 0.0 AND 1.0) THEN 'range:confidence' END",
    ]
    return f"""
WITH r AS (
  SELECT event_id, CASE WHEN {k} >= 95 THEN {body} ELSE {body} || '}}' END AS json FROM events
), p AS (
  SELECT event_id, json, NOT json_valid(json) AS malformed,
         CASE WHEN json_valid(json) THEN json_extract_string(json, '$.decision') END AS dec,
         CASE WHEN json_valid(json) THEN {conf_num} END AS conf,
         CASE WHEN json_valid(json) THEN json_extract_string(json, '$.disclaimer') END AS disc,
         CASE WHEN json_valid(json) THEN json_array_length(json, '$.positives') END AS npos
  FROM r
), e AS (
  SELECT *, CASE WHEN malformed THEN ['malformed'] ELSE list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL) END AS errs
  FROM p
)
SELECT event_id, array_to_string(errs, ',') AS errors, len(errs) = 0 AS valid, dec AS decision, conf AS confidence,
       coalesce(disc, {q(DISCLAIMER_DEFAULT)}) AS disclaimer, CAST(coalesce(npos, 0) AS INTEGER) AS n_positives
FROM e"""


@sql("validate_insights")
def _():
    from filinglens.plans.roles import INSIGHTS_DEFECTS, INSIGHTS_REPLY

    n = f"c_custkey % {len(INSIGHTS_DEFECTS) + 2}"
    cases = " ".join(f"WHEN {i} THEN replace(t, {q(old)}, {q(new)})" for i, (old, new) in enumerate(INSIGHTS_DEFECTS, 2))
    # What each reply must be reported for, said outright.
    want = {
        1: "malformed", 2: "type:company_profile.sector", 3: "missing:company_profile",
        4: "missing:company_profile.ticker,missing:filing_metadata.ticker", 5: "type:filing_metadata.filing_date",
        6: "missing:filing_metadata.period_of_report", 7: "type:high_level_summary", 8: "type:financial_summary.key_metrics",
        9: "item:risk_summary", 10: "item:risk_summary", 11: "type:notable_events", 12: "type:liquidity_and_capital_structure",
        13: "type:liquidity_and_capital_structure.leverage_metrics", 14: "missing:guidance_and_outlook.narrative",
        15: "type:open_questions",
    }
    codes = " ".join(f"WHEN {i} THEN {q(w)}" for i, w in want.items())
    return f"""
WITH t AS (
  SELECT c_custkey, {n} AS n, replace(replace({q(INSIGHTS_REPLY)}, '@name', c_name), '@cik', CAST(c_custkey AS VARCHAR)) AS t FROM customer
), r AS (
  SELECT c_custkey, n, CASE WHEN n = 1 THEN NULL ELSE CASE n {cases} ELSE t END END AS json FROM t
), e AS (SELECT *, CASE n {codes} ELSE '' END AS errors FROM r)
SELECT c_custkey AS record_id, errors, errors = '' AS valid, json_extract_string(json, '$.company_profile.name') AS company_name,
       CASE WHEN json_type(json, '$.high_level_summary') = 'VARCHAR' THEN json_extract_string(json, '$.high_level_summary') END
         AS high_level_summary,
       CAST(coalesce(json_array_length(json, '$.risk_summary'), 0) AS INTEGER) AS n_risks,
       CAST(coalesce(json_array_length(json, '$.open_questions'), 0) AS INTEGER) AS n_questions
FROM e"""


# ---------------------------------------------------------------------------
# Streaming (final state equals the batch result)
# ---------------------------------------------------------------------------


@sql("stream_ingest")
def _():
    return f"""WITH {page_chunks_sql()}
SELECT page_id, CAST(section_order AS INTEGER) AS section_order, chunk_index, chars, md5(text) AS chunk_md5 FROM page_chunks"""


@sql("stream_throughput")
def _():
    return """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM events GROUP BY ALL"""


# ---------------------------------------------------------------------------
# Joins on time, ranks over the whole table, reconciliation, inverted lists
# ---------------------------------------------------------------------------

ARRIVALS_CTE = f"""arrivals AS (
  SELECT event_id, printf('%010d', user_id) AS cik,
         CAST({R.ARRIVALS_FROM} + (epoch_us(ts) // 1000000 - {R.EVENTS_FROM}) * {R.STRETCH} AS BIGINT) AS arrived
  FROM events
)"""
FILED = "CAST(epoch_us(CAST(filing_date AS TIMESTAMP)) // 1000000 AS BIGINT)"


@sql("asof_filing")
def _():
    return f"""WITH {ROLES_CTE}, {ARRIVALS_CTE}, known AS (
  SELECT cik, {FILED} AS filed, max(struct_pack(a := accession_number, f := form_type)) AS r FROM filings GROUP BY ALL
)
SELECT event_id, a.cik, r.a AS accession_number, r.f AS form_type, arrived - filed AS age_seconds
FROM arrivals a ASOF LEFT JOIN known k ON a.cik = k.cik AND a.arrived >= k.filed"""


@sql("valid_at_arrival")
def _():
    days = " ".join(f"WHEN {q(form)} THEN {n}" for form, n in R.HOLDS_DAYS.items())
    return f"""WITH {ROLES_CTE}, {ARRIVALS_CTE}, held AS (
  SELECT cik, accession_number, {FILED} AS begins, {FILED} + 86400 * CASE form_type {days} END AS ends FROM filings
)
SELECT event_id, accession_number, arrived - begins AS age_seconds
FROM arrivals a JOIN held h ON a.cik = h.cik AND begins <= arrived AND arrived < ends"""


@sql("reconcile_filings")
def _():
    return f"""WITH {ROLES_CTE}, l AS (SELECT cik, accession_number FROM filings), s AS (
  SELECT cik, accession_number FROM filings WHERE pos % 3 <> 0 UNION ALL SELECT cik, accession_number FROM filings WHERE pos % 5 = 0
  UNION ALL SELECT cik, 'X' || accession_number FROM filings WHERE pos % 7 = 0
), d AS (
  SELECT *, 1 AS m, 0 AS p FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM s) UNION ALL SELECT *, 0, 1 FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM l)
)
SELECT cik, accession_number, CAST(sum(m) AS BIGINT) AS missing, CAST(sum(p) AS BIGINT) AS surplus FROM d GROUP BY ALL"""


@sql("filing_size_ranks")
def _():
    return """SELECT doc_id, n_chars, row_number() OVER o AS position, rank() OVER v AS rank, percent_rank() OVER v AS percent_rank,
  CAST(ntile(10) OVER o AS INTEGER) AS tile
FROM documents WINDOW v AS (ORDER BY n_chars DESC NULLS LAST), o AS (ORDER BY n_chars DESC NULLS LAST, doc_id)"""


@sql("ann_topk")
def _():
    return f"""
SELECT query_id, vec_id AS top_id, score AS top_score, true AS recall_reached FROM (
  SELECT q.vec_id AS query_id, c.vec_id, s.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c,
       LATERAL (SELECT {cosine('CAST(q.embedding AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS score) s
) WHERE rank = 1"""


@sql("stream_distinct")
def _():
    return "SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events"


@sql("stream_closed_windows")
def _():
    return """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM events GROUP BY date_trunc('hour', ts), event_type
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""


@sql("summary_cube")
def _():
    return """
SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total,
  count(DISTINCT md5(coalesce(text, ''))) AS exact_distinct, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS exact_p50,
  CAST(quantile_disc(n_chars, 0.95) AS BIGINT) AS exact_p95, true AS distinct_near, true AS quantiles_near
FROM documents GROUP BY CUBE (lang, source)"""
