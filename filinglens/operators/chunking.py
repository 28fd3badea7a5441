"""Section splitting and paragraph chunking as in-row array expressions.

Both run inside one narrow stage: no shuffle, no Python worker. A document
is one row until the final ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens.functions.text import py_strip
from filinglens.operators.joins import spread
from filinglens.options import UNKNOWN_SECTION, Options

_JOIN = "\n\n"


def paragraphs(text: Column, sep: str) -> Column:
    """Split on a literal separator, strip each piece, drop blank ones."""
    parts = F.split(text, "\\Q" + sep + "\\E")
    return F.filter(F.transform(parts, py_strip), lambda p: p != F.lit(""))


def chunk_array(text: Column, max_chars: int, overlap_chars: int, sep: str) -> Column:
    """Greedy paragraph packing with a carried overlap tail.

    A paragraph is appended to the buffer (joined by a blank line) until the
    buffer plus the paragraph plus the joiner would exceed ``max_chars``; the
    buffer is then emitted (stripped) and the next buffer starts with the raw
    last ``overlap_chars`` characters of the old one. A single paragraph is
    never cut, so a chunk may be longer than ``max_chars``.
    """
    init = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def merge(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        flush = (F.char_length(cur) + F.char_length(p) + F.lit(2) > F.lit(max_chars)) & (cur != F.lit(""))
        if overlap_chars > 0:
            carried = F.concat(F.right(cur, F.lit(overlap_chars)), F.lit(_JOIN), p)
        else:
            carried = p
        grown = F.when(cur != F.lit(""), F.concat(cur, F.lit(_JOIN), p)).otherwise(p)
        return F.struct(
            F.when(flush, carried).otherwise(grown).alias("cur"),
            F.when(flush, F.concat(acc["out"], F.array(py_strip(cur)))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != F.lit(""), F.concat(acc["out"], F.array(py_strip(acc["cur"])))).otherwise(
            acc["out"]
        )

    return F.aggregate(paragraphs(text, sep), init, merge, finish)


def chunk_text(
    df: DataFrame,
    text_col: str = "text",
    opts: Options = Options(),
    sep: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per chunk: ``keep`` columns + chunk_index, text, chars, oversize."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    df = spread(df.select(*keep, text_col), *keep[:1])
    sep = opts.paragraph_sep if sep is None else sep
    arr = chunk_array(F.col(text_col), opts.max_chars, opts.overlap_chars, sep)
    out = df.select(*keep, F.posexplode(arr).alias("chunk_index", "chunk_text"))
    return (
        out.withColumnRenamed("chunk_text", "text")
        .withColumn("chars", F.char_length("text"))
        .withColumn("oversize", F.col("chars") > F.lit(opts.max_chars))
    )


def heading_starts(lines: Column, heading_regex: str) -> Column:
    """[-1] + positions of heading lines (-1 stands for the headless start)."""
    return F.concat(
        F.array(F.lit(-1)),
        F.filter(
            F.transform(lines, lambda x, i: F.when(x.rlike(heading_regex), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        ),
    )


def section_array(lines: Column, starts: Column, heading_regex: str) -> Column:
    """Lines → array<struct<item, name, body array<string>>>, empties dropped.

    A heading line starts a new section; the lines before the first heading
    form an ``Unknown`` section. A heading directly followed by another
    heading yields no section. Bodies are cut with ``slice`` between heading
    positions, so the cost is linear in the number of lines.
    """

    def make(b: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(lines))
        head = F.get(lines, b)
        return F.struct(
            F.when(b < 0, F.lit(None).cast("string"))
            .otherwise(F.regexp_extract(head, heading_regex, 1))
            .alias("item"),
            F.when(b < 0, F.lit(UNKNOWN_SECTION)).otherwise(F.regexp_extract(head, heading_regex, 2)).alias("name"),
            F.slice(lines, b + 2, end - b - 1).alias("body"),
        )

    return F.filter(F.transform(starts, make), lambda s: F.size(s["body"]) > 0)


def split_sections(
    df: DataFrame,
    lines_col: str = "lines",
    opts: Options = Options(),
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per non-empty section: keep + section_order, section_item,
    section_name, text (body lines joined by a newline)."""
    keep = keep if keep is not None else [c for c in df.columns if c != lines_col]
    staged = df.select(*keep, F.col(lines_col).alias("_lines")).withColumn(
        "_starts", heading_starts(F.col("_lines"), opts.heading_regex)
    )
    out = staged.select(
        *keep,
        F.posexplode(section_array(F.col("_lines"), F.col("_starts"), opts.heading_regex)).alias(
            "section_order", "s"
        ),
    )
    return out.select(
        *keep,
        "section_order",
        F.col("s.item").alias("section_item"),
        F.col("s.name").alias("section_name"),
        F.array_join("s.body", "\n").alias("text"),
    )
