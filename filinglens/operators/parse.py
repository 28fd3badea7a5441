"""Filing HTML → lines → sections → chunks (C5), all narrow expressions.

The whole chain is one stage over the filing rows: no shuffle and no Python
worker. Filing metadata columns are carried through the explodes, never
joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.functions.text import decode_entities, non_blank_lines, strip_boilerplate, strip_markup
from filinglens.operators.chunking import chunk_text, split_sections
from filinglens.operators.joins import spread
from filinglens.options import Options


def html_to_lines(
    df: DataFrame,
    html_col: str = "html",
    keep: list[str] | None = None,
    main_text_only: bool = False,
) -> DataFrame:
    """Add ``lines``: stripped, non-blank text lines of the HTML column."""
    keep = keep if keep is not None else [c for c in df.columns if c != html_col]
    df = spread(df.select(*keep, html_col), *keep[:1])
    html = F.col(html_col)
    if main_text_only:
        html = strip_boilerplate(html)
    # Two projections: the markup-free text is computed once and read twice
    # by the entity step (distinct references, then the replacements).
    bare = df.select(*keep, strip_markup(html).alias("_bare"))
    return bare.select(*keep, non_blank_lines(decode_entities(F.col("_bare"))).alias("lines"))


def explode_lines(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per line: keep + line_no (0-based), line."""
    return df.select(*keep, F.posexplode("lines").alias("line_no", "line"))


def parse_filings(
    df: DataFrame,
    html_col: str = "html",
    keep: list[str] | None = None,
    opts: Options = Options(),
    main_text_only: bool = False,
) -> DataFrame:
    """Chunks of every filing: keep + section_order, section_item,
    section_name, chunk_index, text, chars, oversize."""
    keep = keep if keep is not None else [c for c in df.columns if c != html_col]
    lines = html_to_lines(df, html_col, keep, main_text_only)
    sections = split_sections(lines, "lines", opts, keep)
    return chunk_text(sections, "text", opts, keep=keep + ["section_order", "section_item", "section_name"])
