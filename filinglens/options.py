"""Job options: one frozen dataclass passed to the operators.

Replaces the reference's dependency bundle and settings loader with plain
values. Defaults that must equal the reference's for equal results are kept
together below.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
QUARTERLY_FORMS = ("10-Q", "10-Q/A")
AMENDED_FORMS = ("10-Q/A",)
CHUNK_MAX_CHARS = 2000
CHUNK_OVERLAP_CHARS = 200
SEARCH_DEFAULT_K = 10
RETRIEVE_DEFAULT_K = 20
RETRIEVE_MAX_K = 5
RETRIEVE_MAX_CHARS = 1500
COSINE_EPSILON = 1e-9
HEADING_REGEX = r"(?iU)^item\s+(\d+[A-Z]?)\.\s*(.+)"
UNKNOWN_SECTION = "Unknown"
ARCHIVES_BASE = "https://www.sec.gov/Archives/edgar/data"
THESIS_DEFAULT = "Not explicitly specified; infer a reasonable thesis from the latest 10-Q."
GOAL_DEFAULT = "Summarize and analyze the latest 10-Q into the requested equity research structure."
DECISIONS = ("buy", "sell", "hold")
DISCLAIMER_DEFAULT = (
    "This is an automated, heuristic assessment based on the latest 10-Q filing and "
    "does not constitute investment advice. Do your own research."
)
TICKER_MAP_TTL_HOURS = 6


@dataclass(frozen=True)
class Options:
    forms: tuple[str, ...] = QUARTERLY_FORMS
    amended_forms: tuple[str, ...] = AMENDED_FORMS
    max_chars: int = CHUNK_MAX_CHARS
    overlap_chars: int = CHUNK_OVERLAP_CHARS
    # "\n" splits sections into lines (documented behaviour); "\n\n" is what
    # the reference's parser + chunker actually do (one chunk per section).
    paragraph_sep: str = "\n"
    heading_regex: str = HEADING_REGEX
    search_k: int = SEARCH_DEFAULT_K
    retrieve_k: int = RETRIEVE_DEFAULT_K
    retrieve_max_k: int = RETRIEVE_MAX_K
    retrieve_max_chars: int = RETRIEVE_MAX_CHARS
    # Index layout: rows are bucketed by company so that upserts rewrite only
    # the touched buckets and ticker/cik-filtered searches prune files.
    index_buckets: int = 64
    # Slots of the index's key sidecar and buckets of the landing table: a look-up
    # of few filings reads few of them.
    key_slots: int = 64
    landing_buckets: int = 64
    # Queries and corpus rows of one search cell (one group of a cogroup), at least
    # if there are more; large routes have cells of up to 4 times the queries and 16 times the rows.
    query_block_rows: int = 4096
    corpus_block_rows: int = 4096
