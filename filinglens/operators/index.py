"""Partitioned Parquet chunk index with an idempotent upsert (K5, C8).

Layout: ``bucket = pmod(xxhash64(company key), B)`` partitions. Not by
accession (one tiny folder per filing); not by ticker (a company can hold
a third of all chunks, but it still lands in exactly one bucket, which is
one folder of many files, not one task).

Upsert unit = a whole filing: every old row whose filing is in the batch is
dropped and the batch rows are added, so a re-parse that yields fewer
chunks leaves no stale tail and running the same batch twice changes
nothing. Only buckets touched by the batch are rewritten (dynamic partition
overwrite). The merged rows are checkpointed to the shared checkpoint
folder first, so the write never depends on files it is replacing, and a
lost executor only recomputes from the checkpoint.

Beside the index stands a key sidecar: (filing, partition it may have rows
in), dealt by hash of the filing into slots. Whoever looks filings up reads
only their slots of it, then only the partitions found there. It is never
short of a partition: new places are added before the index is written, old
ones leave it afterwards, so a run cut short costs a needless read at most.

Single writer per index: plain Parquet has no transaction log.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.session import ensure_checkpoint_dir
from filinglens.options import Options

BUCKET_COL = "bucket"
YEAR_COL = "filing_year"
SLOT_COL = "slot"


def with_bucket(df: DataFrame, company_col: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET_COL, F.pmod(F.xxhash64(F.col(company_col)), F.lit(buckets)).cast("int"))


def _clustered(df: DataFrame, parts: list[str]) -> DataFrame:
    """Cluster rows by partition before a partitioned write so each task
    writes few folders (not every task a file in every partition); AQE's
    rebalance splits an oversized (hot) partition and merges small ones."""
    return df.hint("rebalance", *parts)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.exists(p))


def upsert_chunks(
    spark: SparkSession,
    index_path: str,
    batch: DataFrame,
    *,
    filing_key: str = "accession_number",
    company_col: str = "cik",
    date_col: str | None = None,
    filings: DataFrame | None = None,
    opts: Options = Options(),
) -> None:
    """Replace, by filing, the index rows of every filing in ``batch``.

    ``filings``: the keys to replace, if they are more than those of the
    batch's rows (a filing that now parses to no chunk loses its old ones).

    With ``date_col`` the index is partitioned by (``filing_year``,
    ``bucket``), so searches bounded in time prune years too. A filing whose
    company or date changed moves: its old rows are looked up by key
    wherever they are. An empty batch changes nothing.
    """
    b = with_bucket(batch, company_col, opts.index_buckets)
    parts = [BUCKET_COL]
    if date_col:
        # Year 0 holds the filings without a date.
        b = b.withColumn(YEAR_COL, F.coalesce(F.year(F.col(date_col)), F.lit(0)))
        parts = [YEAR_COL, BUCKET_COL]
    replace_rows(spark, index_path, b, parts, filing_key, filings, opts.key_slots)


def replace_rows(spark: SparkSession, index_path: str, b: DataFrame, parts: list[str], filing_key: str, filings: DataFrame | None = None,
                 slots: int = Options().key_slots) -> None:
    """Replace, by filing, rows of a table partitioned by ``parts``: those of
    the filings in ``b`` (and ``filings``) go, the rows of ``b`` come."""
    writer_opts = {"partitionOverwriteMode": "dynamic"}
    ensure_checkpoint_dir(spark)
    # The batch is read several times below; keep it instead of re-deriving it
    # (a lost block is simply recomputed from its lineage).
    b = b.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if not path_exists(spark, index_path):
            if not b.isEmpty():  # a folder without a schema could not be read again
                # Static: the sidecar of an index that was deleted goes.
                _write_places(_places(b, filing_key, parts, slots), sidecar_path(index_path, slots), "overwrite", "static")
                _clustered(b, parts).write.mode("overwrite").options(**writer_opts).partitionBy(*parts).parquet(index_path)
            return
        replaced = (b if filings is None else filings).select(F.col(filing_key)).distinct()
        old = spark.read.parquet(index_path)
        # Where the filings are now (their slots of the sidecar) and where they go:
        # at most one row per partition, so the scan below has partition filters.
        held = find_places(spark, index_path, replaced, filing_key, parts, slots).checkpoint(eager=True)
        touched = [tuple(r) for r in held.select(*parts).unionAll(b.select(*parts)).distinct().collect()]
        if not touched:
            return
        coming, place = _places(b, filing_key, parts, slots), [SLOT_COL, filing_key, *parts]
        known = held if filings is None else find_places(spark, index_path, b, filing_key, parts, slots)
        _write_places(coming.join(known, place, "left_anti"), sidecar_path(index_path, slots), "append")
        merged = (
            old.where(_in_partitions(parts, touched))
            .join(replaced, filing_key, "left_anti")
            .unionByName(b.select(*old.columns))
            .checkpoint(eager=True)
        )
        _clustered(merged, parts).write.mode("overwrite").options(**writer_opts).partitionBy(*parts).parquet(index_path)
        # Dynamic overwrite leaves partitions that get no row as they were.
        filled = {tuple(r) for r in merged.select(*parts).distinct().collect()}
        for values in touched:
            if values not in filled:
                _drop_partition(spark, index_path, parts, values)
        _forget_places(spark, sidecar_path(index_path, slots), held.join(coming, place, "left_anti").checkpoint(eager=True))
    finally:
        b.unpersist()


def _in_partitions(parts: list[str], values: list[tuple]):
    """A condition on partition columns only: bucket lists by year."""
    by_year: dict[tuple, list[int]] = {}
    for v in values:
        by_year.setdefault(v[:-1], []).append(v[-1])
    conds = []
    for year, buckets in by_year.items():
        c = F.col(parts[-1]).isin(buckets)
        conds.append((F.col(parts[0]) == year[0]) & c if year else c)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _drop_partition(spark: SparkSession, index_path: str, parts: list[str], values: tuple) -> None:
    folder = "/".join([index_path.rstrip("/"), *(f"{p}={v}" for p, v in zip(parts, values, strict=True))])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.parquet(index_path)


# ---------------------------------------------------------------------------
# Key sidecar
# ---------------------------------------------------------------------------


def sidecar_path(index_path: str, slots: int) -> str:
    """The number of slots is part of the name: another number never reads
    slots that were dealt differently."""
    return f"{index_path.rstrip('/')}-keys-{slots}"


def _slotted(df: DataFrame, filing_key: str, slots: int) -> DataFrame:
    return df.where(F.col(filing_key).isNotNull()).withColumn(SLOT_COL, F.pmod(F.xxhash64(filing_key), F.lit(slots)).cast("int"))


def _places(rows: DataFrame, filing_key: str, parts: list[str], slots: int) -> DataFrame:
    """Distinct (filing, partition, slot); a null filing cannot be looked up and has none."""
    return _slotted(rows.select(filing_key, *parts).distinct(), filing_key, slots)


def _write_places(places: DataFrame, path: str, mode: str, overwrite: str = "dynamic") -> None:
    _clustered(places, [SLOT_COL]).write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(SLOT_COL).parquet(path)


def find_places(spark: SparkSession, index_path: str, filings: DataFrame, filing_key: str, parts: list[str], slots: int) -> DataFrame:
    """(filing, partition, slot) of the wanted filings, a superset of where
    they have rows. Only their slots are scanned. An index that has no sidecar
    (written before, or with another number of slots) gets one from its keys."""
    path = sidecar_path(index_path, slots)
    index = spark.read.parquet(index_path)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        _write_places(_places(index, filing_key, parts, slots), path, "overwrite", "static")
    wanted = _slotted(filings.select(filing_key).distinct(), filing_key, slots)
    hit = [r[0] for r in wanted.select(SLOT_COL).distinct().collect()]  # at most one row per slot
    schema = T.StructType([*[index.schema[c] for c in (filing_key, *parts)], T.StructField(SLOT_COL, T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path).where(F.col(SLOT_COL).isin(hit))
    return rows.join(wanted, [SLOT_COL, filing_key], "left_semi").select(SLOT_COL, filing_key, *parts)


def _forget_places(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Rewrites the slots that hold places in ``gone`` without these."""
    hit = [r[0] for r in gone.select(SLOT_COL).distinct().collect()]
    if not hit:
        return
    rows = spark.read.schema(gone.schema).parquet(path).where(F.col(SLOT_COL).isin(hit))
    left = rows.distinct().join(gone, gone.columns, "left_anti").checkpoint(eager=True)
    _write_places(left, path, "overwrite")
    filled = {r[0] for r in left.select(SLOT_COL).distinct().collect()}
    for slot in hit:
        if slot not in filled:
            _drop_partition(spark, path, [SLOT_COL], (slot,))


def stored_among(spark: SparkSession, index_path: str, wanted: DataFrame, *, filing_key: str = "accession_number", company_col: str = "cik",
                 opts: Options = Options()) -> DataFrame:
    """Distinct (company, filing) of the index for the filings in ``wanted``
    (their key column is read; null is never found). Scans the partitions that the
    sidecar names for them, and no others. An absent index holds nothing."""
    if not path_exists(spark, index_path):
        return spark.createDataFrame([], f"{company_col} string, {filing_key} string")
    index = read_index(spark, index_path)
    parts = [c for c in (YEAR_COL, BUCKET_COL) if c in index.columns]
    keys = wanted.select(filing_key).distinct()
    held = [tuple(r) for r in find_places(spark, index_path, keys, filing_key, parts, opts.key_slots).select(*parts).distinct().collect()]
    rows = index.where(_in_partitions(parts, held) if held else F.lit(False))
    return rows.select(company_col, filing_key).join(keys, filing_key, "left_semi").distinct().select(company_col, filing_key)
