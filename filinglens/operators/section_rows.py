"""Sections of filings whose lines are rows (UD7), by a table function.

``split_sections`` needs a filing's lines in one array. Where they come as a
table, a Python table function walks each filing's rows in order and carries
what it needs from row to row: the open section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from filinglens.options import UNKNOWN_SECTION, Options


def sections_of_lines(lines: DataFrame, key: str, opts: Options = Options()) -> DataFrame:
    """(``key``, line_no, line) → key, section_order, section_item,
    section_name, text, as ``split_sections`` gives them. Rows are dealt by key
    and sorted by line_no; a task holds one section's lines. Blank (empty) and null lines
    belong to no section, lines with equal numbers come in the order of their
    text, and rows with a null key are one filing."""
    # Java's (?iU) spelled for Python: the same spaces and digits.
    pattern = opts.heading_regex.replace("(?iU)", "(?i)").replace(r"\s", r"\p{White_Space}").replace(r"\d", r"\p{Nd}")
    unknown = UNKNOWN_SECTION
    fields = [T.StructField("section_order", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("section_item", "section_name", "text")]]

    class Sections:
        def __init__(self):
            import regex

            self.heading = regex.compile(pattern)
            self.key, self.order, self.item, self.name, self.body = None, 0, None, unknown, []

        def close(self):
            if self.body:
                yield self.key, self.order, self.item, self.name, "\n".join(self.body)
                self.order += 1

        def eval(self, row):
            self.key = row[key]
            found = self.heading.search(row["line"])
            if found:
                yield from self.close()
                self.item, self.name, self.body = found[1], found[2], []
            else:
                self.body.append(row["line"])

        def terminate(self):
            yield from self.close()

    table = udtf(Sections, returnType=T.StructType([T.StructField(key, lines.schema[key].dataType), *fields]))
    rows = lines.select(key, "line_no", "line").where("line <> ''")
    return table(rows.asTable().partitionBy(key).orderBy("line_no", "line"))
