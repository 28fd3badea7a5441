"""The production settings against brute force on inputs that the given tables do not hold."""

import numpy as np
import pytest

from filinglens.llm import licenses, neighbours, pages, vector_dedup


def table_of(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall_of(out, x, queries, k=20):
    found = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found.get(q, set()) & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hit / (k * len(queries))


def lengths(kind, n):
    r = np.random.default_rng(7)
    if kind == "lognormal":
        return r.lognormal(0, 0.5, n)
    out = np.ones(n)
    if kind == "outlier":
        out[11] = 100
    return out


@pytest.mark.parametrize("kind,n,dims", [("lognormal", 6000, 64), ("outlier", 6000, 64), ("equal", 6000, 256)])
def test_neighbours_keep_their_recall(spark, kind, n, dims):
    x = unit(np.random.default_rng(5).normal(size=(n, dims))) * lengths(kind, n)[:, None]
    out = neighbours.nearest(spark, table_of(spark, x)).collect()
    assert recall_of(out, x, range(0, n, 20)) >= 0.95


def test_neighbours_of_clusters_skip_products_and_keep_recall():
    r = np.random.default_rng(6)
    centres = unit(r.normal(size=(300, 64)))
    x = np.repeat(centres, 30, axis=0) + 0.04 * r.normal(size=(9000, 64))
    q = np.arange(0, 9000, 70)
    s = unit(x[q]) @ unit(x).T
    s[np.arange(len(q)), q] = -1
    near = np.argsort(-s, axis=1)[:, :20]
    pairs = unit(np.repeat(x[q], 20, axis=0)), unit(x[near.ravel()])
    (tables, probes), = neighbours.fitted(*pairs, np.zeros(len(pairs[0]), int), [9000], 6, 1, 23, 64, 0.98)
    assert 0 < tables * probes < 64
    met = np.zeros(len(pairs[0]), bool)
    for t in range(tables):
        met |= (neighbours.buckets(pairs[0], 23 + t, 64, probes) == neighbours.buckets(pairs[1], 23 + t, 64, 1)).any(axis=1)
    assert met.mean() >= 0.98


def spectrum(power, n=6000, dims=64):
    return np.random.default_rng(8).normal(size=(n, dims)) * np.arange(1, dims + 1) ** -power


def common_shifts(n=6000, dims=64):
    r = np.random.default_rng(9)
    x = unit(r.normal(size=(n, dims)))
    x[n // 2 :] = x[: n // 2]
    x[n // 2 :, :4] += 0.22 * unit(r.normal(size=(n - n // 2, 4)))
    return x * 2


@pytest.mark.parametrize("kind", ["spectrum-1", "spectrum-1.5", "shifts"])
def test_vector_dedup_finds_links_along_few_directions(spark, kind):
    x = common_shifts() if kind == "shifts" else spectrum(float(kind.split("-")[1]))
    near = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(near, False)
    out = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(spark, table_of(spark, x)).collect()}
    found = np.array([out[i] for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.999 * near.sum()


@pytest.mark.parametrize("n", [15, 60])
def test_neighbours_of_small_tables_are_all_there(spark, n):
    x = unit(np.random.default_rng(n).normal(size=(n, 64)))
    out = neighbours.nearest(spark, table_of(spark, x), queries="true").collect()
    assert len(out) == n * min(20, n - 1) and recall_of(out, x, range(n), min(20, n - 1)) == 1.0


def test_queries_that_met_too_few_are_scored_against_all(spark, monkeypatch):
    r = np.random.default_rng(10)
    x = unit(np.repeat(r.normal(size=(60, 32)), 5, axis=0) + 0.01 * r.normal(size=(300, 32)))
    monkeypatch.setattr(neighbours, "fitted", lambda *a: [(1, 1)])  # a bucket holds the five or a few more
    out = neighbours.nearest(spark, table_of(spark, x), queries="true").collect()
    fewest = min(sum(r["query_id"] == q for r in out) for q in range(300))
    assert fewest == 20 and sorted((r["query_id"], r["rank"]) for r in out) == [(q, k) for q in range(300) for k in range(1, 21)]


def test_rows_that_repeat_an_id_take_one_place():
    m = np.array([[9.0], [8.0], [9.5], [1.0], [2.0], [3.0]])
    ids, found, score = neighbours.best(np.array([[1.0], [2.0]]), np.array([7, 5]), m, np.array([5, 5, 5, 1, 2, 7]), 2)
    assert list(zip(ids, found, score)) == [(7, 5, 9.5), (7, 2, 2.0), (5, 7, 6.0), (5, 2, 4.0)]


@pytest.mark.parametrize("odd", ["<select>", "<select><option>x", "<svg>", "<svg><path d='M0 0'>", "<object data=x>", "<object><object></object></object>"])
def test_an_open_tag_keeps_the_rest_of_the_page(odd):
    texts = [v.text for v in pages.tree(f"<div>a{odd}</div><article><p>b</p><p>c{odd}<p>d</p></article>") if v.text]
    assert [t for t in texts if t != "x"] == ["a", "b", "c", "d"]
    assert [v.text for v in pages.tree("<p>a<script>b</p>") if v.text] == ["a"]


def test_main_text_after_an_open_tag(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    model = pages.train(table, sample_pages=40, rounds=8, depth=4)
    odd = [f"replace(html, '<article>', '{x}<article>') AS html" for x in ("<div><select><option>x</div>", "<div><object></div>", "<div><svg></div>")]
    want = {r["page_id"]: r["text"] for r in pages.main_text(spark, table, model).collect()}
    for x in odd:
        got = {r["page_id"]: r["text"] for r in pages.main_text(spark, table.selectExpr("page_id", "url", x), model).collect()}
        assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_long_templates_are_found_wherever_they_stand(spark, docs_of):
    template = " ".join(f"t{i}" for i in range(150))
    rows = [(n, " ".join(["word"] * n + [template, "end"])) for n in range(0, 200, 13)]
    out = licenses.license_scan(spark, docs_of(rows), templates=(("long", template),)).collect()
    assert {r["doc_id"]: r["labels"] for r in out} == {n: "long" for n, _ in rows}
    assert {r["step"] for r in licenses.template_rows()} == {16, 64}
