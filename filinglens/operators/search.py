"""Filtered cosine top-k search for many queries at once.

Plan shape:

    queries ──route, query block──┐
                                  ├─ cogroup per cell: score, top-k ─▶ window top-k
    corpus ──route, corpus block──┘

* A query's *route* is its first filter (column and value), or the open
  route if it has none. Only rows with that value meet the query, so no
  other pair is scored; further filters are tested inside the cell.
* The queries and the rows of a route are cut by hash into blocks of at least
  about ``Options.query_block_rows`` and ``Options.corpus_block_rows`` rows,
  larger ones (bounded in rows and bytes) for a large route, because the
  vectors are shuffled once per block of the other side. Every
  (query block, corpus block) cell is one group, so a route with a third of
  all rows is many cells and no task holds more than two blocks. Queries
  never pass through the driver and nothing is broadcast by hand.
* A cell multiplies its blocks as float32 matrices, tile by tile. What may be
  among a query's ``k`` best, given the largest error that such a product can
  have, is scored again in double precision; nothing else is left out.
* A cell yields at most ``k`` rows per query; the final window has a literal
  bound, so each task cuts its rows again before the last shuffle.
* Scores use the same left-to-right summation as the SQL form
  ``aggregate(zip_with(q, v, x*y), 0, +) / (|q|·|v| + 1e-9)``, so they are
  bit-identical to it. Null components count as 0. NaN and infinite
  components are kept: such a score is NaN and ranks after all numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.functions.text import normalize_ticker
from filinglens.functions.vectors import as_double_vector, hash_embedding
from filinglens.options import COSINE_EPSILON, Options
from filinglens.session import scratch_path

# The scorer runs in Python workers. Pickle this module's functions by value
# so the tasks carry the code they run and workers need no installed copy
# of the package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package instead
    pass

def clamp_k(k_col, cap: int | None) -> F.Column:
    """Clamp a requested k to [0, cap] (a negative k returns nothing)."""
    k = F.greatest(F.coalesce(k_col.cast("int"), F.lit(0)), F.lit(0))
    return F.least(k, F.lit(cap)) if cap is not None else k


def _as_matrix(vectors: Sequence, dim: int) -> np.ndarray:
    """Rows of a (n, dim) float64 matrix; positions past a vector's end are 0
    (null components are 0 already)."""
    out = np.zeros((len(vectors), dim), dtype=np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _seq_norm(m: np.ndarray) -> np.ndarray:
    acc = np.zeros(m.shape[0], dtype=np.float64)
    for j in range(m.shape[1]):
        col = m[:, j]
        acc = acc + col * col
    return np.sqrt(acc)


# Cells of a score tile: small enough that the passes over the dimensions
# stay in a core's cache.
_TILE_CELLS = 131_072
# Upper bound on the (queries x rows) scores held by one task.
_SCORE_CELLS = 2_000_000


def _seq_dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(nq, nc) dot products summed in index order (bit-equal to a fold)."""
    out = np.zeros((q.shape[0], c.shape[0]), dtype=np.float64)
    width = max(1, _TILE_CELLS // max(q.shape[0], 1))
    for lo in range(0, c.shape[0], width):
        ct = np.ascontiguousarray(c[lo : lo + width].T)
        acc = np.zeros((q.shape[0], ct.shape[1]), dtype=np.float64)
        term = np.empty_like(acc)
        for j in range(q.shape[1]):
            np.multiply.outer(q[:, j], ct[j], out=term)
            acc += term
        out[:, lo : lo + width] = acc
    return out


# Queries and rows of a tile of the matrix product, and the rows of a tile that
# are looked at together (by their largest score) at most.
_TILE_QUERIES, _TILE_ROWS, _GROUP_ROWS = 256, 1024, 32
# Upper bound on the candidates that wait for their exact score.
_CANDIDATES = 1 << 20
# Vectors shorter than this are multiplied in double precision, as the 1e-9 of
# the score counts there; longer than the other and non-finite ones are not multiplied.
_SHORT, _LONG = 1e-2, 1e100


def _ranked(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, qk: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of each query: NaN last, ties by position of the row (``place``; default: ``ci``)."""
    nan = np.isnan(score)
    order = np.lexsort((ci if place is None else place, np.where(nan, 0.0, -score), nan, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    keep = np.arange(qi.size) - np.searchsorted(qi, qi, side="left") < qk[qi]
    return qi[keep], ci[keep], score[keep]


def _pair_scores(qi: np.ndarray, ci: np.ndarray, qt: np.ndarray, ct: np.ndarray, qnorm: np.ndarray, cnorm: np.ndarray) -> np.ndarray:
    """Exact scores of pairs, summed in index order. ``qt``, ``ct``: a column a vector."""
    acc = np.zeros(qi.size, dtype=np.float64)
    for x, y in zip(qt, ct):
        acc += x[qi] * y[ci]
    return acc / (qnorm[qi] * cnorm[ci] + COSINE_EPSILON)


def _once_per_vector(vectors: np.ndarray, codes: list[np.ndarray], k: int) -> np.ndarray:
    """Positions without those that ``k`` earlier rows with the same vector and
    filter values precede: no query ranks such a row among its ``k`` best."""
    group = pd.factorize(np.array([v.tobytes() for v in vectors], dtype=object))[0]
    for c in codes:
        group = pd.factorize(group * (int(c.max()) + 2) + c + 1)[0]
    return np.flatnonzero(pd.Series(group).groupby(group).cumcount().to_numpy() < k)


def _all_candidates(qpos, cpos, q, c, valid, qk, lists=None):
    """Best of the queries ``qpos`` among the rows ``cpos``, all pairs summed
    in index order."""
    (qmat, qnorm), (cmat, cnorm) = q, c
    parts = []
    step = max(1, _SCORE_CELLS // len(cpos))
    for lo in range(0, len(qpos), step):
        qs = qpos[lo : lo + step]
        scores = _seq_dot(qmat[qs], cmat[cpos]) / (np.multiply.outer(qnorm[qs], cnorm[cpos]) + COSINE_EPSILON)
        ok = valid(qs, cpos)
        if lists is not None:
            inside = lists[0][qs][:, lists[1][cpos]]
            ok = inside if ok is None else ok & inside
        order_by = np.where(np.isnan(scores) | (False if ok is None else ~ok), -np.inf, scores)
        kk = min(int(qk[qs].max()), len(cpos))
        thr = -np.partition(-order_by, kk - 1, axis=1)[:, kk - 1]
        qi, ci = np.nonzero((order_by >= thr[:, None]) & (True if ok is None else ok))
        parts.append(_ranked(qs[qi], cpos[ci], scores[qi, ci], qk))
    return parts


def _product_candidates(qpos, cpos, q, c, valid, qk, single: bool, lists=None):
    """Best of the queries ``qpos`` among the rows ``cpos``: a matrix product,
    with norms divided out, says which pairs may be among the best; those get
    exact scores. ``single``: in float32, else in double precision. ``lists``:
    whether each query looks into each list, and the list of each row; a list's rows are
    multiplied with the queries that look into it only."""
    (qmat, qnorm), (cmat, cnorm) = q, c
    dim = qmat.shape[1]
    # Twice the difference that a product and the exact score may have, twice as wide.
    slack = (dim + 8) * (2.0**-22 if single else 2.0**-50)
    cuts = np.arange(0, len(cpos), _TILE_ROWS)
    if lists is not None:
        cpos = cpos[np.argsort(lists[1][cpos], kind="stable")]
        begin = np.flatnonzero(np.append(True, np.diff(lists[1][cpos]) != 0))
        cuts = np.concatenate([np.arange(lo, hi, _TILE_ROWS) for lo, hi in zip(begin, [*begin[1:], len(cpos)])])
    cuts = [*zip(cuts.tolist(), [*cuts[1:].tolist(), len(cpos)])]
    if single:
        qn, cn = qnorm[qpos], cnorm[cpos]
        slack += 4 * COSINE_EPSILON / (qn.min() * cn.min())
        left = (qmat[qpos] / qn[:, None]).astype(np.float32)
        right = (cmat[cpos] / cn[:, None]).astype(np.float32)
    else:
        left, right = qmat[qpos], cmat[cpos]
    ct = np.ascontiguousarray(cmat.T)
    space = np.empty((min(_TILE_ROWS, len(cpos)), min(_TILE_QUERIES, len(qpos))), dtype=left.dtype)
    parts = []
    for lo in range(0, len(qpos), _TILE_QUERIES):
        qs = qpos[lo : lo + _TILE_QUERIES]
        qt, own = np.ascontiguousarray(qmat[qs].T), np.ascontiguousarray(left[lo : lo + _TILE_QUERIES].T)
        kk = min(int(qk[qs].max()), len(cpos))
        best = np.full((kk, len(qs)), -np.inf, dtype=left.dtype)  # lower bounds of the kk largest so far
        held, n_held = [], 0

        def settle(held):
            qi, ci, near = (np.concatenate(x) for x in zip(*held))
            some = near >= (best[0] - slack)[qi]
            qi, ci = qi[some], ci[some]
            exact = _pair_scores(qi, cpos[ci], qt, ct, qnorm[qs], cnorm)
            return _ranked(qi, ci, exact, qk[qs], cpos[ci])

        every = np.arange(len(qs))
        for at, to in cuts:
            asks = every if lists is None else np.flatnonzero(lists[0][qs, lists[1][cpos[at]]])
            if not len(asks):
                continue
            tile = space.reshape(-1)[: (to - at) * len(asks)].reshape(to - at, len(asks))
            np.matmul(right[at:to], own if len(asks) == len(qs) else own[:, asks], out=tile)
            if not single:
                tile /= np.multiply.outer(cnorm[cpos[at:to]], qnorm[qs[asks]]) + COSINE_EPSILON
            ok = valid(qs[asks], cpos[at:to])
            if ok is not None:
                tile[~ok.T] = -np.inf
            width = max(1, min(_GROUP_ROWS, len(tile) // (2 * kk)))
            n = len(tile) // width
            # Row j * n + g of the tile is in group g; what is left over is a group a row.
            tops = tile[: n * width].reshape(width, n, len(asks)).max(axis=0)
            tops = np.concatenate([tops, tile[n * width :]])
            risen = np.flatnonzero(tops.max(axis=0) > best[0, asks])
            bound = np.concatenate([best[:, asks[risen]], tops[:, risen]])
            best[:, asks[risen]] = np.partition(bound, len(bound) - kk, axis=0)[len(bound) - kk :]
            least = best[0, asks] - slack
            g, qi = np.nonzero((tops >= least) & (tops > -np.inf))
            rest = g >= n
            rows = g[~rest] + n * np.arange(width)[:, None]
            cols = np.broadcast_to(qi[~rest], rows.shape).ravel()
            rows = np.concatenate([rows.ravel(), g[rest] - n + n * width])
            cols = np.concatenate([cols, qi[rest]])
            near = tile[rows, cols]
            some = (near >= least[cols]) & (near > -np.inf)
            held.append((asks[cols[some]], at + rows[some], near[some]))
            n_held += len(held[-1][0])
            if n_held > _CANDIDATES:  # keeps the k best of each query so far, by their exact scores
                qi, ci, exact = settle(held)
                held, n_held = [(qi, ci, np.full(len(qi), np.inf))], len(qi)
        if not held:
            continue
        qi, ci, exact = settle(held)
        parts.append((qs[qi], cpos[ci], exact))
    return parts


def _cell_scorer(key_cols: list[str], n_filters: int, in_lists: bool = False):
    """Build the cogroup function: exact top-k of one cell's queries among
    its rows. ``in_lists``: among the rows whose ``_list`` is in the query's ``_lists``."""

    def score_cell(qs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "score", "k", *key_cols]
        if qs.empty or rows.empty:
            return pd.DataFrame(columns=columns)
        # Rows in key order: their position is the tie-break of the ranking.
        rows = rows.sort_values(key_cols, kind="mergesort", na_position="first").reset_index(drop=True)
        qvecs, cvecs = qs["_vec"].tolist(), rows["_vec"].tolist()
        dim = max(max(map(len, qvecs)), max(map(len, cvecs)), 1)
        qmat, cmat = _as_matrix(qvecs, dim), _as_matrix(cvecs, dim)
        qk = qs["k"].to_numpy(dtype=np.int64)
        qids = qs["query_id"].to_numpy()
        tests, codes_of = [], []
        for i in range(n_filters):
            codes, uniq = pd.factorize(rows[f"_f{i}"].to_numpy(dtype=object), use_na_sentinel=True)
            want = qs[f"_f{i}"].to_numpy(dtype=object)
            open_ = pd.isna(want)
            qcode = pd.Index(uniq, dtype=object).get_indexer(want)
            qcode[qcode < 0] = -2  # a value no row of the cell has
            codes_of.append(codes)
            if not (open_ | ((qcode == 0) & (codes == 0).all())).all():  # else all rows fit
                tests.append((open_, qcode, codes))

        lists = None
        if in_lists:
            codes, uniq = pd.factorize(rows["_list"])
            codes_of.append(codes)
            at = pd.Index(uniq).get_indexer(np.concatenate(qs["_lists"].tolist()))
            owner = np.repeat(np.arange(len(qs)), [len(x) for x in qs["_lists"]])
            lists = np.zeros((len(qs), len(uniq)), dtype=bool), codes
            lists[0][owner[at >= 0], at[at >= 0]] = True

        def valid(qpos: np.ndarray, cpos: np.ndarray) -> np.ndarray | None:
            out = None
            for open_, qcode, codes in tests:
                ok = open_[qpos, None] | (qcode[qpos, None] == codes[None, cpos])
                out = ok if out is None else out & ok
            return out

        with np.errstate(all="ignore"):
            q, c = (qmat, _seq_norm(qmat)), (cmat, _seq_norm(cmat))
            some = _once_per_vector(cmat, codes_of, int(qk.max()))
            kind = lambda norm: np.where(~(norm <= _LONG), 2, np.where(norm < _SHORT, 1, 0))
            q_kind, c_kind = kind(q[1]), kind(c[1][some])
            parts = []
            for i in range(3):
                for j in range(3):
                    qpos, cpos = np.flatnonzero(q_kind == i), some[c_kind == j]
                    if not len(qpos) or not len(cpos):
                        continue
                    most = int(qk[qpos].max())
                    if max(i, j) == 2 or 8 * most > len(cpos) or 4 * most > _TILE_ROWS:
                        parts += _all_candidates(qpos, cpos, q, c, valid, qk, lists)
                    else:
                        parts += _product_candidates(qpos, cpos, q, c, valid, qk, i == j == 0, lists)
        if not parts:  # no query looks into a list of the cell
            return pd.DataFrame(columns=columns)
        qi, ci, score = _ranked(*(np.concatenate(x) for x in zip(*parts)), qk)
        out = rows.iloc[ci][key_cols].reset_index(drop=True)
        out.insert(0, "k", qk[qi].astype(np.int32))
        out.insert(0, "score", score)
        out.insert(0, "query_id", qids[qi])
        return out

    return score_cell


# Most rows of a block of queries, as a multiple of Options.query_block_rows, and of a
# block of rows likewise; most components; blocks of queries if rows suffice; least cells.
_QUERY_ROWS, _CORPUS_ROWS, _COMPONENTS, _QUERY_BLOCKS, _CELLS = 4, 16, 1 << 22, 32, 32


def _vector(df: DataFrame, name: str) -> F.Column:
    """The column with 0 for null components; floats stay floats (doubles only in the scorer)."""
    kind = df.select(name).schema[0].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    col = F.col(name) if floats else as_double_vector(F.col(name))
    return F.transform(col, lambda x: F.coalesce(x, F.lit(0.0).cast("float" if floats else "double")))


def cosine_topk(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    key_cols: Sequence[str],
    vector_col: str = "embedding",
    query_vector_col: str = "qvec",
    k_col: str = "k",
    filter_cols: Sequence[str] = (),
    partition_col: str | None = None,
    opts: Options = Options(),
) -> DataFrame:
    """Exact top-k by cosine for every query.

    ``queries``: ``query_id`` (long), ``qvec`` (array<double>), ``k`` (int,
    already clamped) and one nullable column per name in ``filter_cols``
    holding the value that corpus column must equal (null or '' = no filter).
    Put the most selective filter first: it routes the query.

    ``partition_col``: a column the stored corpus is partitioned by. When
    every query has a filter, the partitions that hold some wanted value are
    looked up first (filter columns only) and only those are scanned.

    Returns ``query_id, rank, score`` + ``key_cols`` ordered by score
    descending, ties broken by the key columns ascending.
    """
    spark: SparkSession = corpus.sparkSession
    key_cols, n = list(key_cols), len(filter_cols)
    fcols = [f"_f{i}" for i in range(n)]
    route, cell = ["_rc", "_rv"], ["_rc", "_rv", "_qb", "_cb"]
    out_schema = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("k", T.IntegerType())]
        + [corpus.schema[c] for c in key_cols]
    )

    q = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        _vector(queries, query_vector_col).alias("_vec"),
        F.col(k_col).cast("int").alias("k"),
        *[F.nullif(F.col(f).cast("string"), F.lit("")).alias(c) for f, c in zip(filter_cols, fcols)],
    ).where(F.col("_vec").isNotNull() & (F.col("k") > 0))
    # The route: number of the first filter set (n: open) and its value.
    q = q.withColumn("_rc", F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(fcols)], F.lit(n)))
    q = q.withColumn("_rv", F.coalesce(*[F.col(c) for c in fcols], F.lit("")))
    q_routes = q.groupBy(*route).agg(F.count(F.lit(1)).alias("_nq"), F.max("k").alias("_k"))
    used = {r["_rc"]: r["_k"] for r in q_routes.groupBy("_rc").agg(F.max("_k").alias("_k")).collect()}  # <= n + 1 rows
    kmax = max(used.values(), default=0)

    def routed(df: DataFrame, *cols) -> DataFrame:
        """One copy of a row for every kind of route in use."""
        named = df.select(*cols, *[F.col(f).cast("string").alias(c) for f, c in zip(filter_cols, fcols)])
        kinds = [
            F.struct(F.lit(i).alias("_rc"), (F.col(fcols[i]) if i < n else F.lit("")).alias("_rv")) for i in sorted(used)
        ]
        return named.select("*", F.inline(F.array(*kinds))).where(F.col("_rv").isNotNull())

    empty = spark.createDataFrame([], out_schema)
    if used and partition_col and n not in used:
        held = routed(corpus, partition_col).join(q_routes, route, "left_semi").select(partition_col).distinct()
        corpus = corpus.where(F.col(partition_col).isin([r[0] for r in held.collect()]))  # one value per partition
    n_cells = 0
    if used:
        # Blocks per route. A single open route is one row; other grids are
        # written, so that the planner knows the table's size.
        sizes = routed(corpus, F.size(vector_col).alias("_dim")).groupBy(*route).agg(F.count(F.lit(1)).alias("_nc"), F.max("_dim").alias("_dim"))
        sizes = sizes.join(q_routes, route)

        def blocks(n: str, rows: int, most: int, wanted):
            """Few and large ones, as long as memory is bounded and the cells are enough."""
            least = F.greatest(F.ceil(F.col(n) / (rows * most)), F.ceil(F.col(n) * F.col("_dim") / _COMPONENTS))
            return F.greatest(least, F.least(F.ceil(F.col(n) / rows), wanted)).cast("long")

        grid = sizes.withColumn("_qbs", blocks("_nq", opts.query_block_rows, _QUERY_ROWS, F.lit(_QUERY_BLOCKS)))
        grid = grid.withColumn("_cbs", blocks("_nc", opts.corpus_block_rows, _CORPUS_ROWS, F.ceil(F.lit(_CELLS) / F.col("_qbs")))).select(*route, "_qbs", "_cbs")
        only = grid.first() if set(used) == {n} else None
        if set(used) != {n}:
            path = scratch_path(spark, "search-grid")
            grid.write.parquet(path)
            grid = spark.read.parquet(path)
            n_cells = grid.agg(F.sum(F.col("_qbs") * F.col("_cbs"))).first()[0] or 0
        elif only:
            n_cells = only["_qbs"] * only["_cbs"]
    if n_cells:
        # A fixed count: cells are small in bytes and heavy in work, so they
        # must not be merged by size.
        tasks = max(1, min(n_cells, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        if only:  # large cells: about one each
            tasks = min(n_cells, 2000)

        def block(hash_cols, count):
            return F.pmod(F.xxhash64(*hash_cols), F.col(count))

        def each(count):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))

        def sized(df):
            if only:
                return df.withColumn("_qbs", F.lit(only["_qbs"])).withColumn("_cbs", F.lit(only["_cbs"]))
            return df.join(grid, route)

        left = sized(q).withColumn("_qb", block(["query_id"], "_qbs")).withColumn("_cb", each("_cbs"))
        c = routed(corpus, *key_cols, _vector(corpus, vector_col).alias("_vec")).where(F.col("_vec").isNotNull())
        right = sized(c).withColumn("_cb", block(key_cols, "_cbs")).withColumn("_qb", each("_qbs"))
        left = left.select(*cell, "query_id", "k", "_vec", *fcols).repartition(tasks, *cell)
        right = right.select(*cell, *key_cols, "_vec", *fcols).repartition(tasks, *cell)
        hits = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_cell_scorer(key_cols, n), out_schema)
    else:
        hits = empty
    hits = hits.withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # pandas hands NaN back as null
    best_first = [F.isnan("score"), F.col("score").desc(), *[F.col(c).asc() for c in key_cols]]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))
    ranked = hits.withColumn("rank", rank).where((F.col("rank") <= F.lit(kmax)) & (F.col("rank") <= F.col("k")))
    return ranked.select("query_id", "rank", "score", *key_cols)


def listed_topk(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    key_cols: Sequence[str],
    list_col: str,
    vector_col: str = "embedding",
    opts: Options = Options(),
) -> DataFrame:
    """As ``cosine_topk`` (without filters), each query among the rows of its own
    lists only: the numbers in its column ``lists``. ``corpus`` is partitioned by
    ``list_col``; only lists that some query looks into are scanned. Lists are put together in
    groups of bounded size (a longer list is cut by hash), and a query goes once to each group that
    holds some of its lists, not once to each list."""
    spark: SparkSession = corpus.sparkSession
    key_cols = list(key_cols)
    path = scratch_path(spark, "listed-queries")
    queries.select(
        F.col("query_id").cast("long").alias("query_id"), _vector(queries, "qvec").alias("_vec"), F.col("k").cast("int").alias("k"), F.col("lists").alias("_lists")
    ).where(F.col("_vec").isNotNull() & (F.col("k") > 0) & (F.size("_lists") > 0)).write.parquet(path)
    q = spark.read.parquet(path)
    out_schema = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("k", T.IntegerType())]
        + [corpus.schema[c] for c in key_cols]
    )
    asked = [r[0] for r in q.select(F.explode("_lists")).distinct().collect()]  # as many as there are lists at most
    corpus = corpus.where(F.col(list_col).isin(asked))
    sizes = corpus.groupBy(F.col(list_col).alias("_list")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("dim")).orderBy("_list").collect()
    nq = q.count()
    # A row for each list: its first group and how many groups it is cut over.
    most = max(1, min(_CORPUS_ROWS * opts.corpus_block_rows, _COMPONENTS // max([1, *(r["dim"] for r in sizes)])))
    places, group, filled = [], 0, 0
    for r in sizes:
        if filled and filled + r["n"] > most:
            group, filled = group + 1, 0
        cut = -(-r["n"] // most)
        places.append((r["_list"], group, cut))
        group, filled = (group + cut, 0) if cut > 1 else (group, filled + r["n"])
    if not nq or not places:
        hits = spark.createDataFrame([], out_schema)
    else:
        groups = spark.createDataFrame(places, "_list int, _first int, _cut int")
        qbs = max(-(-nq // (_QUERY_ROWS * opts.query_block_rows)), min(_QUERY_BLOCKS, -(-nq // opts.query_block_rows)))
        tasks = min(qbs * (group + 1), 2000)
        held, first, cut_over = (np.array(x, dtype=np.int64) for x in zip(*places))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A query once for each group, with its lists there."""
            for b in batches:
                flat = b["_lists"].flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), np.diff(b["_lists"].offsets.to_numpy()))
                at = np.minimum(np.searchsorted(held, flat), len(held) - 1)
                met = held[at] == flat
                row, flat, at = row[met], flat[met], at[met]
                if not len(row):
                    continue
                n = cut_over[at]
                each = np.repeat(np.arange(len(at)), n)
                g = first[at][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((g, row[each]))
                row, g, flat = row[each][order], g[order], flat[each][order]
                start = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(g) != 0)))
                inside = pa.ListArray.from_arrays(pa.array([*start, len(flat)], pa.int32()), pa.array(flat, pa.int32()))
                take = pa.array(row[start])
                yield pa.RecordBatch.from_arrays([pa.array(g[start], pa.int32()), *(b[c].take(take) for c in ("query_id", "k", "_vec")), inside], names=["_g", "query_id", "k", "_vec", "_lists"])

        left = q.mapInArrow(spread, f"_g int, query_id long, k int, _vec {q.schema['_vec'].dataType.simpleString()}, _lists array<int>")
        left = left.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(qbs)))
        right = corpus.select(F.col(list_col).alias("_list"), *key_cols, _vector(corpus, vector_col).alias("_vec")).where(F.col("_vec").isNotNull()).join(F.broadcast(groups), "_list")
        right = right.select((F.col("_first") + F.pmod(F.xxhash64(*key_cols), F.col("_cut"))).cast("int").alias("_g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qbs - 1).cast("long"))).alias("_qb"), "_list", *key_cols, "_vec")
        left, right = (x.repartition(tasks, "_g", "_qb") for x in (left, right))
        hits = left.groupBy("_g", "_qb").cogroup(right.groupBy("_g", "_qb")).applyInPandas(_cell_scorer(key_cols, 0, True), out_schema)
    hits = hits.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    best_first = [F.isnan("score"), F.col("score").desc(), *[F.col(c).asc() for c in key_cols]]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))
    return hits.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).select("query_id", "rank", "score", *key_cols)


def list_places(centroids: DataFrame, n: int):
    """A function that gives each row of a matrix its ``n`` nearest lists, in the
    order that ``cosine_topk`` has: by score, ties by number."""
    rows = centroids.orderBy("list").collect()  # a row per list
    numbers, center = np.array([r["list"] for r in rows], dtype=np.int64), _as_matrix([r["centroid"] for r in rows], max([1, *(len(r["centroid"]) for r in rows)]))

    def near(vectors: list) -> list[list[int]]:
        out = []
        for lo in range(0, len(vectors), 256):
            some = vectors[lo : lo + 256]
            dim = max(center.shape[1], *map(len, some))
            q, c = _as_matrix(some, dim), np.pad(center, ((0, 0), (0, dim - center.shape[1])))
            score = _seq_dot(q, c) / (np.multiply.outer(_seq_norm(q), _seq_norm(c)) + COSINE_EPSILON)
            out += numbers[np.argsort(-score, axis=1, kind="stable")[:, :n]].tolist()
        return out

    return near


def embed_queries(queries: DataFrame, text_col: str = "text", embedder=None) -> DataFrame:
    emb = embedder or hash_embedding
    return queries.withColumn("qvec", emb(F.col(text_col)))


def search(
    index: DataFrame,
    queries: DataFrame,
    *,
    opts: Options = Options(),
    key_cols: Sequence[str] = ("accession_number", "section_order", "chunk_index"),
    cap: int | None = None,
    partition_col: str | None = "bucket",
) -> DataFrame:
    """Filtered similarity search over a chunk index (C9).

    ``queries``: query_id, qvec, optional ``k`` (default 10), optional
    ``ticker``, ``cik``, ``section_name`` and ``accession_number`` filters
    (null or '' = off; an accession pins one filing instead of mixing a
    company's older filings into the answer). The
    ticker filter is case-insensitive: it compares the stored
    ``ticker_norm`` with the normalised query value. A filter on a column
    that the index lacks raises.
    """
    asked = {"accession_number": "accession_number", "cik": "cik", "ticker_norm": "ticker", "section_name": "section_name"}
    asked = {stored: given for stored, given in asked.items() if given in queries.columns}
    lacking = [stored for stored in asked if stored not in index.columns]
    if lacking:
        raise ValueError(f"the index has no column {', '.join(lacking)} to filter on")
    q = queries.select(
        "query_id",
        "qvec",
        clamp_k(F.col("k") if "k" in queries.columns else F.lit(opts.search_k), cap).alias("k"),
        *[
            (normalize_ticker(F.col(given)) if stored == "ticker_norm" else F.col(given).cast("string")).alias(stored)
            for stored, given in asked.items()
        ],
    )
    part = partition_col if partition_col in index.columns else None
    return cosine_topk(index, q, key_cols=key_cols, filter_cols=list(asked), partition_col=part, opts=opts)
