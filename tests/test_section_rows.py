"""The table function over lines gives what the array expressions give."""

import random

from pyspark.sql import functions as F

from filinglens.operators.chunking import split_sections
from filinglens.operators.section_rows import sections_of_lines


def test_equals_split_sections_in_any_row_order(spark):
    rng = random.Random(5)
    kinds = ["Item 1. Business", "item 1A.Risk", "ITEM 7.   MD&A", "Item 9.", "Item ٣. Digits", "not an Item 1. here", "plain", "text é", "Item 2. Gap"]
    # The first filing is as long as a third of all rows.
    rows = [(k, i, rng.choice(kinds)) for k in range(12) for i in range(400 if k == 0 else rng.randrange(1, 60))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id long, line_no int, line string").repartition(5)
    lines = df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    got = sections_of_lines(df, "id")
    assert got.columns == ["id", "section_order", "section_item", "section_name", "text"]
    assert sorted(got.collect(), key=str) == sorted(split_sections(lines, "lines", keep=["id"]).collect(), key=str)


def test_nulls_ties_and_empty_tables(spark):
    schema = "id string, line_no int, line string, section_name string"
    rows = [("a", 0, None, "x"), ("a", 1, "", "x"), ("a", 2, "b", "x"), ("a", 2, "a", "x"), ("a", 2, "a", "x"), (None, 0, "n", "x"), ("h", 0, "Item 1. Only", "x")]
    got = sections_of_lines(spark.createDataFrame(rows, schema), "id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 0, None, "Unknown", "a\na\nb"), (None, 0, None, "Unknown", "n")], key=str)
    assert sections_of_lines(spark.createDataFrame([], schema), "id").collect() == []
