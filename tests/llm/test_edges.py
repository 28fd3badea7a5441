"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing
columns; results against brute force on small fixtures."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from filinglens.llm import licenses, mixture, neighbours, pages, pieces, quality, shards, shingle_join, tokens, vector_dedup
from filinglens.llm.graph import connected_components

LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, ""), (4, None), (None, "x y z"), (5, LONG), (6, LONG + "end"), (7, "A b  c")]


def test_quality_learns_and_scores_everything(spark, docs_of):
    good = [(i, f"plain words number {i} make a calm sentence here.") for i in range(80)]
    bad = [(i, f"BUY!! NOW!! {i}!! CLICK!! HERE!!") for i in range(80, 160)]
    docs = docs_of(good + bad + [(900, None), (901, ""), (None, "calm words"), (902, LONG)])
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score_quality(spark, docs, model).withColumn("held", quality.held_out()).collect()
    assert len(out) == 164 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held"] and r["doc_id"] < 160]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["predicted"] == (r["doc_id"] < 80) for r in held)
    assert quality.fit(docs, labels.limit(0)).bias == 1.0
    assert quality.score_quality(spark, docs.limit(0), model).count() == 0


def test_licenses(spark, docs_of):
    rows = [(1, "x Under  the MIT-license, under the mit license"), (2, "see: this work is LICENSED under the gnu general public license (version 3)"), (3, None), (4, "under the mit"),
            (5, "word " * 5000 + "CC BY-NC 4.0"), (5, "word " * 5000 + "CC BY-NC 4.0")]
    out = licenses.license_scan(spark, docs_of(rows)).orderBy("doc_id").collect()
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in out]
    assert got == [(1, 9, 2, 1, 5, "mit", "mit"), (2, 13, 0, None, None, "", "gpl-3"), (3, 0, 0, None, None, "", ""), (4, 3, 0, None, None, "", ""),
                   (5, 5005, 1, 5000, 5000, "cc-by-nc", "cc-by-nc"), (5, 5005, 1, 5000, 5000, "cc-by-nc", "cc-by-nc")]
    assert licenses.license_scan(spark, docs_of([])).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 100, 1023, 1025):
        assert sorted(shards.feistel(np.arange(n), n, 7)) == list(range(n))
    assert list(shards.feistel(np.arange(100), 100, 7)) != list(shards.feistel(np.arange(100), 100, 8))


def test_shards_read_back(spark, docs_of):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out, at, n = shards.write_shards(spark, docs_of(ROWS), path, length=16, per_shard=64)
    rows = out.collect()
    assert sorted(r["slot"] for r in rows) == list(range(n))
    ids = shards.read_slots(spark, at, 30, n - 30, length=16, per_shard=64)
    assert {r["slot"]: r["ids_crc"] for r in rows if r["slot"] >= 30} == {30 + i: zlib.crc32(x.tobytes()) for i, x in enumerate(ids)}
    want = shards.encoding(path).encode_ordinary(ROWS[0][1]) + [shards.END]
    first = next(r for r in rows if r["doc_id"] == 1)
    got = shards.read_slots(spark, at, first["slot"], 1, length=16, per_shard=64)[0]
    assert got.tolist() == want + [shards.END] * (16 - len(want)) and first["n_tokens"] == len(want)
    assert {r["doc_id"] for r in rows} == {1, 2, 5, 6, 7, None}
    empty, _, none = shards.write_shards(spark, docs_of([]), path)
    assert none == 0 and empty.count() == 0


def test_mixture(spark, docs_of):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(400)] + [(900, None, "s0"), (901, "", None), (902, "a b", None), (902, "a b", None)]
    out = mixture.mix(spark, docs_of(rows)).collect()
    goal = {r["source"]: r["target"] for r in out}
    size = {r["source"]: r["source_size"] for r in out}
    assert len(out) == len(rows) and math.isclose(sum(goal.values()), 1.5 * sum(size.values()))
    for s in goal:
        taken = sum(r["taken"] for r in out if r["source"] == s)
        assert goal[s] - 3 <= taken <= goal[s] and goal[s] <= 2 * size[s]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert mixture.mix(spark, docs_of([])).count() == 0


def test_flow_serves_overlapping_sources():
    took = mixture.allocate({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 12})
    assert took == {("a",): 10, ("a", "b"): 10, ("b",): 2}  # nothing repeated: the shared ten go to b
    took = mixture.allocate({("a",): 10}, {"a": 99})
    assert took == {("a",): 20}


def test_pieces(spark, docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*ROWS, (8, " two  spaces \n\n and <s> € \U0001f600 \x00"), (9, "\n x")]
    out = pieces.encode_pieces(docs_of(rows), path).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert len(out) == len(rows) and all(r["parity"] and r["round_trip"] for r in out)
    assert sorted(map(tuple, (r["token_ids"] for r in out))) == sorted(tuple(library.encode(t or "")) for _, t in rows)
    assert pieces.encode_pieces(docs_of([]), path).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS label", "2 AS norm", "'x' AS vec", "3 AS list")


def odd_vectors(n=200, d=16):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, d))
    x[50:60] = x[50]  # copies
    x[60:90] = x[60] + 0.05 * r.normal(size=(30, d))
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    return rows, [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [1.0] * 3), (1004, [None] * d), (None, [1.0] * d), (1005, [])]


def test_vector_dedup_matches_brute_force(spark):
    rows, odd = odd_vectors()
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in x:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    out = vector_dedup.near_duplicates(spark, vectors_of(spark, rows + odd), rows_per_list=40, slack=4.0).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert all(got[i] == (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x)))
    assert all(got[i] == (0, i, i is not None) for i, _ in odd) and len(out) == len(rows) + len(odd)
    assert vector_dedup.near_duplicates(spark, vectors_of(spark, [])).count() == 0


def test_neighbours_match_brute_force(spark):
    rows, odd = odd_vectors()
    x = np.array([v for _, v in rows])
    x[100:] *= 3  # unequal lengths
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    x = np.array([v for _, v in rows])
    out = neighbours.nearest(spark, vectors_of(spark, rows + odd), tables=8, probes=64).collect()
    hit = 0
    for q in range(0, 200, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(200), -s)) if i != q][:20]
        assert [m[0] for m in mine] == list(range(1, 21)) and all(math.isclose(m[2], s[m[1]], rel_tol=1e-12) for m in mine)
        hit += len({m[1] for m in mine} & set(want))
    assert hit >= 0.95 * 200
    assert neighbours.nearest(spark, vectors_of(spark, [])).count() == 0


def test_shingle_join_edges(spark, docs_of):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [*ROWS, (20, base), (21, base.replace("w30 ", "")), (22, base.upper()), (23, base + " x y"), (24, "a b c"), (25, "A  B\tc"), (26, "a b")]
    out = shingle_join.shingle_components(spark, docs_of(rows)).collect()
    got = {r["doc_id"]: r["component_id"] for r in out}
    assert len(out) == len(rows)
    # 5 and 6 repeat ten shingles; the end adds three.
    sets = {i: set(zip(*[(t or "").lower().split()[k:] for k in range(4)])) for i, t in rows if i in (5, 6)}
    linked = 100 * len(sets[5] & sets[6]) >= 85 * len(sets[5] | sets[6])
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, None: None, 5: 5, 6: 5 if linked else 6, 7: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 24, 25: 24, 26: 26}
    assert {r["doc_id"]: r["n_shingles"] for r in out}[3] == 0
    assert shingle_join.shingle_components(spark, docs_of([])).count() == 0


def test_signatures_meet_for_every_close_pair():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.08], r.integers(0, 2**63, int(r.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        keys = [{int(s) for _, _, x, y in shingle_join.signatures(v, 85) for s in (*x, *y)} for v in (a, b)]
        assert keys[0] & keys[1]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    out = connected_components(spark, edges).collect()
    assert len({r["component"] for r in out if r["id"] <= 40}) == 1 and len(out) == 43 and len({r["component"] for r in out}) == 2


@pytest.mark.parametrize("text", [LONG, "é" * 5000 + " <|endoftext|> it's " * 400, "a" * 9000, " \n" * 3000 + "x", "don't  stop\n\n\n" * 700])
def test_spliced_counts_equal_whole_counts(text):
    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    want = len(t.encode(text, add_special_tokens=False).ids)
    assert tokens.count_spliced(t, text, chunk=700, overlap=48) == want
    assert tokens.Counter(t).counts([text]) == [want]


def test_token_counts(spark, docs_of):
    out = tokens.token_counts(docs_of(ROWS), public_tokenizers.path("byte_bpe_50k.json"), chunk=10_000).collect()
    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((len((x or "").encode()), n := len(t.encode(x or "").ids), n > 512) for _, x in ROWS)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == want
    assert tokens.token_counts(docs_of([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_page_tree():
    texts = lambda p: [v.text for v in pages.tree(p) if v.text]
    assert texts("<p>it's <a href=x'y>link</a> don't</p>") == ["it's link don't"]
    assert texts("<p>a<p>b<br>c</div><script>x</p></script>d") == ["a", "b", "c", "d"]
    assert texts("a &amp; b&nbsp;c<!-- x --> <b>d</b>") == ["a & b c d"]
    assert texts("") == []


def test_main_text(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    model = pages.train(table, sample_pages=40, rounds=8, depth=4)
    odd = spark.createDataFrame([(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, "<nav><a>x</a></nav>")], "page_id long, url string, html string")
    out = pages.main_text(spark, odd.selectExpr("*", "1 AS text"), model).collect()
    assert len(out) == 4 and all(r["text"] == "" and r["n_chars"] == 0 for r in out)
    got = pages.main_text(spark, table, model).collect()
    plain = {r["page_id"]: r["html"] for r in table.collect()}
    for r in got:
        inside = plain[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"] == "\n".join(v.text for v in pages.tree(inside) if v.text)


def test_what_a_set_wants_is_told_without_its_signatures(spark, docs_of, monkeypatch):
    """The signatures are shuffled by node once, for the segments; to choose look-ups their number will do."""
    plans, write = {}, shingle_join.staged
    monkeypatch.setattr(shingle_join, "staged", lambda s, df, name, **k: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(s, df, name, **k))[1])
    rows = [(i, " ".join(f"w{j % 90 + (j == i)}" for j in range(100))) for i in range(4)]
    out = shingle_join.shingle_components(spark, docs_of(rows + [(9, rows[1][1])])).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 0}
    assert "min_by" in plans["shingle-segments"] and "min_by" not in plans["shingle-lookups"]
