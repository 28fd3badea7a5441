"""Operator 2: license scan by an exact set-similarity join, in DataFrame
operations only.

Text blocks (windows of words) are joined with license templates on their
words. Words are ordered by how many documents hold them, rarest first; a
template is looked up by its prefix only (any block that holds enough of it
must hold one of these words), pairs that cannot reach the overlap by length
or position are dropped, and the rest is counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import renamed, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that make a label wherever their words stand in a row.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices as their licenses word them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9


def _step(words: int) -> int:
    """16, 64, or for longer templates the next power of two."""
    return 16 if words <= 16 else max(64, 1 << (words - 1).bit_length())


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Distinct words, block step and least overlap of each template. Blocks
    are ``2 * step`` words long and start every ``step`` words, so any run
    of a template's length lies within one."""
    out = []
    for i, (label, text) in enumerate(templates):
        tokens = text.replace(".", " ").split()
        words = sorted(set(tokens))
        out.append({"template": i, "label": label, "words": words, "step": _step(len(tokens)),
                    "need": math.ceil(threshold * len(words) - 1e-9)})
    return out


def _normal(text: Column) -> Column:
    """Words of the text in lower case (A-Z only matters), one space apart.
    ``lower`` maps two other letters to a-z; texts with those take the slow way."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _starts(words: Column, phrase: str) -> Column:
    """Positions, from 0, where the phrase's words stand in a row."""
    p = phrase.split()
    n = F.size(words) - len(p)
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))

    def here(i):
        out = F.get(words, i) == p[0]
        for k, w in enumerate(p[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.filter(at, here)


def license_scan(
    spark: SparkSession, docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_base, first_word,
    last_word, base_labels, labels, score.

    A document is labelled when a block of it holds at least ``threshold`` of a
    template's distinct words, besides the labels of its phrases. ``score``: 1
    with a phrase, else the largest share of a template found in a block that
    reached the threshold, else 0. Null and empty texts have no words and no
    labels (empty strings); repeated rows each keep a row; other columns are
    not read."""
    rules = template_rows(templates, threshold)
    text = renamed(docs, doc_id="doc_id", text="text").select("doc_id", _normal(F.col("text")).alias("normal"))
    words = F.when(F.col("normal") == "", F.array().cast("array<string>")).otherwise(F.split("normal", " "))

    # The global order: in how many documents each template word stands.
    vocabulary = sorted({w for r in rules for w in r["words"]})
    counts = (
        text.select(F.explode(F.array_intersect(words, _array(vocabulary))).alias("word"))
        .groupBy("word").count().collect()  # a row per template word at most
    )
    often = {r["word"]: r["count"] for r in counts}
    ranked = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    index = []
    for r in rules:
        r["words"].sort(key=rank.get)
        index += [(w, r["template"], r["label"], r["step"], r["need"], k, len(r["words"]), r["words"])
                  for k, w in enumerate(r["words"][: len(r["words"]) - r["need"] + 1])]
    # A few rows per template.
    index = spark.createDataFrame(index, "word string, template int, label string, step int, need int, at int, n int, words array<string>")
    prefixes = sorted({r["words"][k] for r in rules for k in range(len(r["words"]) - r["need"] + 1)})

    found = F.array(*[F.struct(F.lit(label).alias("label"), F.when(F.contains(F.concat(F.lit(" "), "normal", F.lit(" ")), F.lit(f" {p} ")),
                                                                   _starts(F.col("words"), p)).otherwise(F.array().cast("array<int>")).alias("starts"))
                      for p, label in phrases])
    rows = staged(
        spark,
        text.select("doc_id", "normal", words.alias("words")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"),
            F.when(F.arrays_overlap("words", _array(prefixes)), F.col("words")).alias("words"),
        ), "licenses")

    blocks = None
    for step in sorted({r["step"] for r in rules}):
        part = rows.where(F.col("words").isNotNull()).select(
            "row", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))).alias("start"))
        # Rarest words first: array_intersect keeps the order of its first array.
        part = part.select("row", F.lit(step).alias("step"), F.array_intersect(_array(ranked), F.slice("words", F.col("start") + 1, 2 * step)).alias("block"))
        blocks = part if blocks is None else blocks.unionAll(part)
    pairs = blocks.where(F.arrays_overlap("block", _array(prefixes))).select(
        "row", "step", "block", F.size("block").alias("size"), F.posexplode("block").alias("pos", "word")
    ).join(F.broadcast(index), ["word", "step"])
    able = (F.col("size") >= F.col("need")) & (
        F.least("pos", "at") + 1 + F.least(F.col("size") - F.col("pos"), F.col("n") - F.col("at")) - 1 >= F.col("need"))
    overlap = F.size(F.array_intersect("block", "words"))
    labelled = (
        pairs.where(able).select("row", "label", "need", (overlap / F.col("n")).alias("share"), overlap.alias("overlap"))
        .where(F.col("overlap") >= F.col("need"))
        .groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    )

    starts = F.flatten(F.transform("found", lambda f: f["starts"]))
    base = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda f: F.size(f["starts"]) > 0), lambda f: f["label"])))
    return rows.join(labelled, "row", "left").select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
