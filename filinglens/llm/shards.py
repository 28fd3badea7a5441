"""Operator 3: training-order materialisation of token ids.

Texts are encoded once and cut into sequences of one length. Sequences are
numbered 0 to N - 1 in the order of a hash of (doc_id, text), whatever the
files or splits they came in; a keyed Feistel network permutes the numbers (values of
N and more are sent through it again until they fall below: cycle walking), so
a sequence's place in training is a function of its number and the key alone.
Ranges of places are shards: files of fixed-stride records in training order,
so a reader seeks to any place, and resumes there, without an index.

Shards are written by Spark's text writer (the two bytes of the line end are
part of the stride), hence by its commit protocol and to any file system Spark
knows. A shard reaches the writer as one value, its records already in order.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import mix64, renamed, staged, strings
from filinglens.session import scratch_path

LINE_END = "\n\n"  # fills the stride up to whole 16-bit ids
END = 50256
# Fixed value: how the vocabulary's words are split.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The place of each number below ``n`` under the key: a permutation."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.uint64(key & (1 << 64) - 1) + np.arange(1, rounds + 1, dtype=np.uint64))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & low
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & low)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def packer(common: bytes):
    """Compresses chunks of records against ids that all tasks know."""
    import zstandard

    known = zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=6)  # for all chunks of a task; reading them needs no such tables
    return zstandard.ZstdCompressor(level=6, dict_data=known).compress


def unpacker(common: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompress


def write_shards(
    spark: SparkSession, docs: DataFrame, ranks_path: str, out_path: str | None = None, length: int = 256,
    per_shard: int = 16_384, key: int = 20_240_229,
) -> tuple[DataFrame, str, int]:
    """Writes the shards to ``out_path`` (default: under the shared folder), as
    ``shard=<k>/part-*``: records of ``length`` little-endian uint16 ids and a
    line end. Returns (sequences, path, N); sequences: doc_id, seq_no, slot,
    shard, n_tokens (padding not counted), ids_crc of every sequence.

    Each text's ids are followed by one END, and its last sequence is filled up
    with END. Null and empty texts give no sequence; repeated rows each give
    theirs (equal rows take neighbouring numbers, in any order); equal texts of
    different ids are ordered by the hash; a null id is hashed as absent. Other columns are not
    read. The same rows in other files give the same slots and shards. Memory of
    a task is bounded by its Arrow batch or by one shard (``per_shard`` records,
    at most 65,536)."""
    if not 0 < per_shard <= 1 << 16:
        raise ValueError("per_shard must be 1 to 65536")
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # ranges of the hash; a number each reaches the driver

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoding(ranks_path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                ids = [np.array(x + [END], dtype="<u2") if x else np.zeros(0, "<u2") for x in words.encode_ordinary_batch(strings(some["text"]), num_threads=1)]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["h"], some["g"], some["bucket"], pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "h", "g", "bucket", "size", "ids"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's first number within its bucket: rows come in order, a bucket in one task."""
        now, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            n = -(-b["size"].to_numpy() // length)
            bucket = b["bucket"].to_numpy()
            before = np.cumsum(n) - n
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            base = np.repeat(before[starts], np.diff(np.append(starts, len(n))))
            first = before - base
            if bucket[0] == now:
                first[: starts[1] if len(starts) > 1 else None] += at
            now, at = bucket[-1], int(first[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["bucket"], pa.array(first), pa.array(n), b["size"], b["ids"]],
                                             names=["doc_id", "bucket", "first", "n", "size", "ids"])

    # The upper bits of h, as a number from 0, give the bucket: buckets are ranges of h.
    own = renamed(docs, doc_id="doc_id", text="text").where("text != ''").withColumn("h", F.xxhash64("doc_id", "text"))
    own = own.withColumn("g", F.xxhash64(F.lit(key), "text", "doc_id"))
    own = own.withColumn("bucket", F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    rows = own.mapInArrow(encode, f"doc_id {kind}, h long, g long, bucket int, size long, ids binary")
    rows = rows.repartition(max(1, buckets // 16), "bucket").sortWithinPartitions("bucket", "h", "g")
    coded = staged(spark, rows.mapInArrow(numbered, f"doc_id {kind}, bucket int, first long, n long, size long, ids binary"), "token-ids", level=6)
    parts = {r["bucket"]: r["n"] for r in coded.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most ``buckets`` rows
    total, offset = 0, np.zeros(buckets, dtype=np.int64)
    for p in sorted(parts):
        offset[p], total = total, total + parts[p]

    # Ids of some texts, which chunks of records are compressed against: a chunk has few records where shards are many.
    some = coded.where("n > 0").select(F.substring("ids", 1, 4096).alias("ids")).limit(1024).collect()  # 4 MB at most
    common = spark.sparkContext.broadcast(b"".join(bytes(r["ids"]) for r in some)[: 1 << 21])

    def sequences(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each sequence: its row, its number in the row, its ids, its place."""
        n, first = b["n"].to_numpy(), b["first"].to_numpy() + offset[b["bucket"].to_numpy()]
        row = np.repeat(np.arange(len(n)), n)
        no = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ids = np.full((len(row), length), END, dtype="<u2")
        flat, at = ids.reshape(-1), 0
        for raw, k in zip(b["ids"].to_pylist(), n, strict=True):
            x = np.frombuffer(raw, "<u2")
            flat[at : at + len(x)] = x
            at += int(k) * length
        return row, no, ids, feistel(first[row] + no, total, key)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                row, no, ids, slot = sequences(some)
                size = some["size"].to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"].take(pa.array(row)), pa.array(no), pa.array(slot), pa.array(slot // per_shard), pa.array(np.minimum(length, size - no * length)),
                     pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                    names=["doc_id", "seq_no", "slot", "shard", "n_tokens", "ids_crc"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records by shard, compressed together: fewer and smaller rows to shuffle."""
        pack = packer(common.value)
        for b in batches:
            _, _, ids, slot = sequences(b)
            order = np.argsort(slot, kind="stable")
            ids, slot = ids[order], slot[order]
            shards, at = np.unique(slot // per_shard, return_index=True)
            slot = (slot % per_shard).astype("<u2")  # within the shard
            cut = [*at, len(slot)]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array([slot[i:j].tobytes() for i, j in spans], pa.binary()),
                 pa.array([pack(ids[i:j].tobytes()) for i, j in spans], pa.binary())], names=["shard", "slots", "records"])

    def ordered(t: pa.Table) -> pa.Table:
        unpack = unpacker(common.value)
        slot = np.concatenate([np.frombuffer(x, "<u2") for x in t["slots"].to_pylist()])
        ids = np.concatenate([np.frombuffer(unpack(x), "<u2").reshape(-1, length) for x in t["records"].to_pylist()])
        ends = np.full((len(slot), length + len(LINE_END) // 2), int.from_bytes(LINE_END.encode(), "little"), dtype="<u2")
        ends[:, :length] = ids[np.argsort(slot)]
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int64()), "records": pa.array([ends.tobytes()[: -len(LINE_END)]], pa.binary())})

    path = out_path or scratch_path(spark, "token-shards")
    shards = (
        coded.select("bucket", "first", "n", "ids").mapInArrow(dealt, "shard long, slots binary, records binary")
        .groupBy("shard").applyInArrow(ordered, "shard long, records binary")
        .select("shard", F.col("records").cast("string").alias("value"))
    )
    # A shard is one row: with a writer open per shard of a task nothing is sorted before writing.
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "64")
    try:
        shards.write.partitionBy("shard").option("lineSep", LINE_END).text(path)
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
    out = coded.mapInArrow(listed, f"doc_id {kind}, seq_no long, slot long, shard long, n_tokens long, ids_crc long")
    return out, path, total


def read_slots(spark: SparkSession, path: str, start: int, count: int, length: int = 256, per_shard: int = 16_384) -> np.ndarray:
    """The records of places ``start`` to ``start + count - 1``, as rows of
    ids: what a reader that resumes at ``start`` gets. Few shards are opened."""
    out = []
    for shard in range(start // per_shard, (start + count - 1) // per_shard + 1):
        raw = spark.read.format("binaryFile").load(f"{path}/shard={shard}").select("content").first()["content"]
        rows = np.frombuffer(raw, "<u2").reshape(-1, length + len(LINE_END) // 2)[:, :length]
        out.append(rows[max(0, start - shard * per_shard) : start + count - shard * per_shard])
    return np.concatenate(out)
