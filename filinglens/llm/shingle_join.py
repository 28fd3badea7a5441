"""Operator 7: Jaccard self-join on word shingles by universe partition.

Two sets with Jaccard >= t differ in at most H shingles, H known from their
sizes. If all shingles are dealt by a hash into more than H segments, two such
sets agree exactly in at least one segment. Documents are therefore indexed by
the content of their segments, per band of sizes (a band fixes the number of
segments), and only documents that share a segment are compared.

Which segments a document looks its partners up by is chosen by cost: any
H + 1 of its non-empty segments do, so it takes the ones the fewest other
documents hold; a document with H + 1 segments that nobody shares has no
partner at all. A document with too few non-empty segments also tries its
segments with one shingle deleted (such a segment covers two differences),
and its empty segments only if even that is not enough.

Documents with one set are one node. Candidates are compared exactly, first
with the best-connected node of each shared segment, so a large group of near
copies costs a star and not all its pairs. Documents that share a segment but
are still in different components after that meet in blocks of bounded size,
by group and size band; a block counts all its intersections at once and
hands on no more than one link per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filinglens.llm.common import mix64, renamed, staged, strings
from filinglens.llm.graph import connected_components
from filinglens.llm.grid import in_blocks, local_components

BAND = 1.5  # the largest size of a band is this times the smallest
SPARE = 0.12  # segments beyond H + 1, so that a document can leave some out


class Shingles:
    """64-bit hashes of the distinct k-word shingles of texts: words are runs
    of non-space characters with A-Z in lower case; fewer than k words make
    one shingle, none make none."""

    def __init__(self, k: int, most: int = 150_000):
        self.k, self.most, self.known = k, most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: ASCII letters and ASCII space only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out *= np.uint64(0x9E3779B97F4A7C15)  # odd: no word is lost
            out += h[i : len(h) - k + 1 + i]
        return np.unique(mix64(out))


def differences(a: int, b: int, percent: int) -> int:
    """The most shingles in which sets of these sizes may differ."""
    t = Fraction(percent, 100)
    return int((1 - t) / (1 + t) * (a + b))


def band_of(n: int) -> int:
    band, top = 0, 1
    while top < n:
        band, top = band + 1, max(top + 1, int(top * BAND))
    return band


def band_top(band: int) -> int:
    top = 1
    for _ in range(band):
        top = max(top + 1, int(top * BAND))
    return top


def signatures(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each band in which a set may have partners no smaller than the
    band's: (band, need, segments, extra). ``segments``: signatures of its
    non-empty segments; ``need``: of how many any choice finds all partners;
    ``extra``: signatures to look up besides if there are fewer."""
    out, own, largest = [], band_of(len(s)), len(s) * 100 // percent
    for band in range(own, band_of(largest) + 1):
        top = band_top(band)
        parts = differences(top, top, percent) + 1
        parts += int(SPARE * parts) + 1
        need = differences(len(s), min(largest, top), percent) + 1
        at = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        filled, first = np.unique(at[order], return_index=True)
        value = mix64(s + np.uint64(0x9E3779B97F4A7C15))[order]
        sums = np.add.reduceat(value, first)  # modulo 2**64
        name = np.uint64(band + 1 << 32) + filled.astype(np.uint64)
        segments = mix64(sums ^ mix64(name))
        extra = []
        if len(filled) < need:
            sizes = np.diff(np.append(first, len(s)))
            for i in np.flatnonzero(sizes > 1):
                extra.append(mix64((sums[i] - value[first[i] : first[i] + sizes[i]]) ^ mix64(name[i : i + 1])))
            if len(filled) + (sizes > 1).sum() < need:
                empty = np.setdiff1d(np.arange(parts), filled).astype(np.uint64)
                extra.append(mix64(mix64(np.uint64(band + 1 << 32) + empty)))
        out.append((band, need, segments, np.unique(np.concatenate(extra)) if extra else np.zeros(0, np.uint64)))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(k)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sizes, nodes, bands = [], [], []
                for t in strings(part["text"]):
                    s = of(t)
                    sizes.append(len(s))
                    nodes.append(int(_signed(mix64(np.add.reduce(mix64(s), keepdims=True) + np.uint64(len(s))))[0]) if len(s) else None)
                    bands.append([{"band": band, "need": need, "segments": _signed(x), "extra": _signed(y)} for band, need, x, y in signatures(s, percent)] if len(s) else [])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.struct(
                    [("band", pa.int32()), ("need", pa.int32()), ("segments", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64()))])))],
                    names=["doc_id", "n_shingles", "node", "bands"])
    return run


def _texts(k: int, as_sets: bool = False):
    """Texts (or sets) of the nodes asked for; a doc_id may name several texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(k)
        for b in batches:
            nodes = b["node"].to_pylist()
            keep, held = [], []
            for i, t in enumerate(strings(b["text"])):
                s = of(t)
                if len(s) and int(_signed(mix64(np.add.reduce(mix64(s), keepdims=True) + np.uint64(len(s))))[0]) == nodes[i]:
                    keep.append(i)
                    held.append(s.tobytes() if as_sets else t)
            yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(keep, pa.int64())), pa.array(held, pa.binary() if as_sets else pa.string())],
                                             names=["node", "shingles" if as_sets else "text"])
    return run


def _shared_sets(percent: int):
    """Links between two blocks of sets that are in different components: one
    per set at most, enough to connect what is linked."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        a, b = (t["node"].to_numpy() for t in (left, right))
        sets = [np.frombuffer(x, np.uint64) for t in (left, right) for x in t["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        x, y = size[: len(a), None], size[None, len(a) :]
        able = (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]) & (100 * x >= percent * y) & (100 * y >= percent * x)
        if not able.any():
            return none
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        side = row < len(a)
        n = int(column.max()) + 1
        both = (np.bincount(column[side], minlength=n) > 0) & (np.bincount(column[~side], minlength=n) > 0)
        place = np.cumsum(both) - 1
        keep = both[column]
        row, column = row[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, int(both.sum()), 4096):
            i, j = np.searchsorted(column, (lo, lo + 4096))
            held = np.zeros((len(sets), 4096), np.float32)
            held[row[i:j], column[i:j] - lo] = 1
            shared += held[: len(a)] @ held[len(a) :].T
        rows, cols = np.nonzero(able & (100 * shared >= percent * (x + y - shared)))
        names = np.unique(np.concatenate([a[rows], b[cols]]))
        root = local_components(np.searchsorted(names, a[rows]), np.searchsorted(names, b[cols]), len(names))
        hit = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": pa.array(names[hit], pa.int64()), "b": pa.array(names[root[hit]], pa.int64())})
    return run


def _verified(k: int, percent: int):
    """Pairs (a, b) whose sets reach the threshold, counted exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(k)
        last, right = None, None
        for b in batches:
            keep = []
            a_text, b_node, b_text = b["a_text"], b["b"].to_pylist(), b["b_text"]
            for i in range(b.num_rows):
                if b_node[i] != last:
                    last, right = b_node[i], of(b_text[i].as_py())
                left = of(a_text[i].as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def shingle_components(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id: long,
    text). Two documents link when 100 * |A and B| >= percent * |A or B| of
    their distinct k-word shingles; component_id is the smallest doc_id reachable.

    Null and empty texts have no shingles and are alone, as is a row without a
    doc_id (component null). Repeated rows each keep a row; a doc_id that names
    several texts joins their components under what each text links with.
    Other columns are not read. Shingles are compared as 64-bit hashes."""
    text = renamed(docs, doc_id="doc_id", text="text")
    sets = staged(spark, text.mapInArrow(_sets(k, percent),
        "doc_id long, n_shingles long, node long, bands array<struct<band:int,need:int,segments:array<long>,extra:array<long>>>"), "shingle-sets")
    rows = sets.select("doc_id", "n_shingles", "node")
    named = sets.where("node IS NOT NULL AND doc_id IS NOT NULL")
    # Copies are one node, held by its smallest document.
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    nodes = staged(spark, nodes, "shingle-nodes")

    flat = named.groupBy("node").agg(F.min_by("bands", "doc_id").alias("bands"))
    flat = flat.select("node", F.explode("bands").alias("x")).select("node", "x.*")
    segments = flat.select(F.explode("segments").alias("sig"), "node", "band", F.lit(False).alias("extra")).unionAll(
        flat.where(F.size("extra") > 0).select(F.explode("extra").alias("sig"), "node", "band", F.lit(True).alias("extra")))
    segments = segments.select("sig", "node", F.when(F.col("extra"), -F.col("band") - 1).otherwise(F.col("band")).alias("band"))
    alike = F.count("*").over(Window.partitionBy("sig"))
    shared = staged(spark, segments.withColumn("n", alike).where("n > 1"), "shingle-segments")

    # Of the need, segments that nobody shares find nobody; the rest is taken where it is cheapest.
    # Copies want the same, and how much is a few numbers: the signatures aren't shuffled for it again.
    wants = named.select("node", F.transform("bands", lambda x: F.struct(x["band"].alias("band"), x["need"].alias("need"), F.size(x["segments"]).alias("filled"))).alias("w"))
    wants = wants.groupBy("node").agg(F.first("w").alias("w")).select("node", F.inline("w"))
    per = shared.where("band >= 0").groupBy("node", "band").agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("by_cost"))
    chosen = per.join(wants, ["node", "band"]).withColumn("take", F.col("need") - (F.col("filled") - F.col("k")))
    chosen = chosen.where("take > 0").select("node", F.explode(F.transform(F.slice("by_cost", 1, F.least("take", "k")), lambda x: x["sig"])).alias("sig"))
    chosen = chosen.unionAll(shared.where("band < 0").select("node", "sig"))
    asked = staged(spark, chosen.withColumn("asks", F.lit(True)), "shingle-lookups")
    live = asked.select("sig").distinct()
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    groups = staged(spark, shared.select("sig", "node").join(live, "sig").join(asked.distinct(), ["sig", "node"], "left")
                    .groupBy("sig", "node").agg(F.coalesce(F.max("asks"), F.lit(False)).alias("asks"))
                    .join(nodes.select("node", "n", "doc_id"), "node").join(degree, "node"), "shingle-groups")

    def fits(x: str, y: str):
        return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    # The hub of a segment shares most segments with others: copies of one text differ less from it than from each other.
    hubs = groups.groupBy("sig").agg(F.max(F.struct("degree", "node", "n", "asks")).alias("hub"))
    star = groups.join(hubs, "sig").where((F.col("node") != F.col("hub.node")) & (F.col("asks") | F.col("hub.asks")) & fits("n", "hub.n"))
    star = staged(spark, star.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), "shingle-star")

    def content(wanted: DataFrame, as_sets: bool = False) -> DataFrame:
        rows = text.join(wanted.join(nodes.select("node", "doc_id"), "node"), "doc_id").select("node", "text")
        rows = rows.mapInArrow(_texts(k, as_sets), "node long, shingles binary" if as_sets else "node long, text string")
        return staged(spark, rows.dropDuplicates(["node"]), "shingle-texts")

    found = content(star.select(F.col("a").alias("node")).unionAll(star.select(F.col("b").alias("node"))).distinct())
    pairs = star.join(found.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(
        found.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    links = staged(spark, pairs.select("a", "a_text", "b", "b_text").mapInArrow(_verified(k, percent), "a long, b long"), "shingle-links")
    parts = connected_components(spark, links)

    # Documents that share a segment and are still apart.
    at = groups.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = at.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.min("node").alias("first"))
    apart = staged(spark, at.join(split.where("lo <> hi AND size > 2").select("sig", "first"), "sig").select("first", "node", "n", "component"), "shingle-apart")
    if not apart.isEmpty():
        cluster = connected_components(spark, apart.select(F.col("node").alias("a"), F.col("first").alias("b")))
        sized = apart.select("node", "n", "component").distinct().join(cluster.select(F.col("id").alias("node"), F.col("component").alias("cluster")), "node")
        # Sets that fit are in one band of sizes or in neighbours; the base is a hair wide for rounding.
        size_band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent) * 1.0001)).cast("int")
        sized = sized.join(content(sized.select("node"), as_sets=True), "node").withColumn("size_band", size_band)
        sized = staged(spark, sized, "shingle-blocks")
        member = sized.select(*[F.col(c).alias(c) for c in sized.columns])
        query = sized.withColumn("size_band", F.explode(F.array(F.col("size_band"), F.col("size_band") + 1)))
        q, m, keys = in_blocks(query, member, ["cluster", "size_band"], 1_000_000, 1_000_000, id="node", weight=F.col("n") + 2000)
        more = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(_shared_sets(percent), "a long, b long")
        more = staged(spark, more, "shingle-links")
        if not more.isEmpty():
            parts = connected_components(spark, links.unionAll(more))

    # A doc_id with several texts ties nothing together by its id alone.
    low = parts.join(nodes.select(F.col("node").alias("id"), "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = parts.join(low, "component").select(F.col("id").alias("node"), "component_id")
    lone = nodes.join(linked.select("node"), "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    known = linked.unionAll(lone)
    has = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    out = rows.where(has).join(known, "node").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(rows.where(~has).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
