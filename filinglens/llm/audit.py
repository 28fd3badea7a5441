"""Operator 12: how filters overlap, for every order in which they may run.

A filter is a condition that a row fails or not. Repeats of a text are found
by a left-semi self-join (hash, exact text, smaller id); its rows are united
with those that fail the other filters and summed per combination of failure
bits. Every figure of every order follows from those few combinations.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import renamed, staged

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> list[Column]:
    """Whether a (non-null) text is short, repetitive, upper-case, marked up."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * different < 50 * n, 100 * capitals > 3 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def repeats(spark: SparkSession, docs: DataFrame, hashes: DataFrame, copies_per_task: int = 1000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose exact text a smaller
    doc_id has too; a null id is neither smaller nor larger. ``hashes``: (doc_id,
    hash) of all rows. Only texts with a repeated hash are compared, and moved
    if the list of those hashes is too long to broadcast (by the planner's own
    threshold, on a written table). A hot text's rows are dealt over as many tasks
    as it has thousands of copies; its smallest id goes to each of them."""
    again = hashes.groupBy("hash").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("_n"))
    again = staged(spark, again.where("_low < _high").select("hash", F.ceil(F.col("_n") / copies_per_task).cast("int").alias("_parts")), "repeated-hashes")
    rows = docs.join(again, "hash").withColumn("_part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("_parts")))
    first = rows.groupBy("hash", "text", "_parts").agg(F.min("doc_id").alias("_first"))
    first = first.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1))).drop("_parts")
    first = first.select(*[F.col(c).alias(f"_f{c}") for c in first.columns])
    same = (F.col("hash") == F.col("_fhash")) & (F.col("_part") == F.col("_f_part")) & (F.col("text") == F.col("_ftext"))
    return rows.join(first, same & (F.col("_f_first") < F.col("doc_id")), "left_semi").drop("_part", "_parts")


def failure_bits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, part, n, bits) of ``docs``: bit i is set where filter i of the
    four text filters fails, bit 4 where the text repeats one of a smaller id.
    ``n`` rows that agree in id, text and part are one row here."""
    rows = renamed(docs, doc_id="doc_id", text="text", lang="lang").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.withColumn("hash", F.md5("text"))
    bits = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(text_filters(F.col("text")))), F.lit(0))
    other = staged(spark, rows.select("doc_id", "part", "hash", F.lit(1).alias("n"), bits.alias("bits")), "failures")
    copies = repeats(spark, rows, other.select("doc_id", "hash")).select("doc_id", "part", "hash", F.lit(0).alias("n"), F.lit(16).alias("bits"))
    return other.unionAll(copies).groupBy("doc_id", "part", "hash").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).drop("hash")


def interactions(combos: DataFrame, letters: str) -> DataFrame:
    """The figures of every order of the filters ``letters`` (bit i: letter i),
    from (part, bits, n, good, toxic), one row per part and combination."""
    orders = ["".join(p) for p in permutations(letters)]
    per = combos.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("_c"))  # 2 ** filters at most
    per = per.select("part", "_c", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    per = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    place = lambda c: F.call_function("shiftleft", F.lit(1), F.call_function("locate", c, F.lit(letters)) - 1)
    earlier = F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")
    none = F.col("step") == 1
    per = per.withColumn("_own", place(F.substring("filter_order", F.col("step"), F.lit(1))))
    per = per.withColumn("_before", F.when(none, 0).otherwise(F.aggregate(earlier, F.lit(0), lambda m, c: m.bitwiseOR(place(c)))))

    def total(column: str, holds) -> Column:
        return F.aggregate(F.filter("_c", holds), F.lit(0).cast("long"), lambda acc, x: acc + x[column])

    own, before = F.col("_own"), F.col("_before")
    fails = lambda x: x["bits"].bitwiseAND(own) != 0
    left = lambda x: x["bits"].bitwiseAND(before) == 0
    # A row that fails f filters is removed by each of them in 1 / f of the orders.
    shares = F.aggregate(F.filter("_c", fails), F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.call_function("div", F.lit(len(orders)), F.bit_count(x["bits"])))
    return per.select(
        "part", "filter_order", "step",
        total("n", lambda x: left(x) & ~fails(x)).alias("kept"),
        total("n", lambda x: left(x) & fails(x)).alias("removed"),
        total("n", lambda x: ~left(x) & fails(x)).alias("redundant"),
        total("n", lambda x: x["bits"] == own).alias("unique_fails"),
        total("good", lambda x: left(x) & fails(x)).alias("good_lost"),
        total("toxic", lambda x: left(x) & fails(x)).alias("toxic_lost"),
        shares.alias("shapley"),
    )


def filter_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (value of ``lang``, null as empty), order of the filters
    ABCDE and step, with the counts kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley.

    Null texts count as empty. Rows that repeat an id each count, and are no E of
    each other (the id is not smaller); a null id is never E. A label
    of an id counts for all its rows; of several labels of an id, any 1 counts. Tables
    without documents give no rows. Other columns are not read. What reaches
    one task per part are at most 32 sums.
    """
    marks = renamed(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    rows = failure_bits(spark, docs).join(marks, "doc_id", "left")
    n = F.col("n")
    combos = rows.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return interactions(combos, "ABCDE")
