"""Inputs that earlier versions of the operators got wrong."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from filinglens.llm import pages, pieces, shards, vector_dedup

RANKS = "byte_bpe_50k.tiktoken"


def test_slots_do_not_depend_on_files_or_splits(spark, docs_of, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.random()}" for _ in range(r.randrange(1, 60)))) for i in range(300)] + [(7, "same"), (7, "same"), (900, ""), (901, None), (None, "x y")]
    docs = docs_of(rows)
    docs.repartition(7).write.parquet(str(tmp_path / "a"))
    docs.orderBy("text").coalesce(1).write.parquet(str(tmp_path / "b"))
    got, seqs = [], []
    for name in "ab":
        out, path, n = shards.write_shards(spark, spark.read.parquet(str(tmp_path / name)), public_tokenizers.path(RANKS), length=16, per_shard=32)
        seqs.append(sorted(map(tuple, out.collect()), key=repr))
        got.append(shards.read_slots(spark, path, 0, n, length=16, per_shard=32))
    assert seqs[0] == seqs[1] and (got[0] == got[1]).all()
    # An independent table of places: rows in hash order, their sequences numbered, the number permuted.
    hashed = docs.where("text != ''").selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h").collect()
    words, number, want = shards.encoding(public_tokenizers.path(RANKS)), 0, {}
    for d in sorted(hashed, key=lambda d: d["h"]):
        ids = words.encode_ordinary(d["text"]) + [shards.END]
        for lo in range(0, len(ids), 16):
            want[number] = (ids[lo : lo + 16] + [shards.END] * 16)[:16]
            number += 1
    place = shards.feistel(np.arange(number), number, 20_240_229)
    assert number == len(got[0]) and all(got[0][place[i]].tolist() == want[i] for i in want)


def test_vectors_that_repeat_an_id_count_on_their_own(spark):
    x = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.0, 1.0, 0.02]), (5, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(spark, table).collect())
    assert out == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5)]


def test_repeated_ids_match_brute_force(spark):
    r = np.random.default_rng(12)
    x = np.repeat(r.normal(size=(40, 16)), 6, axis=0) + 0.1 * r.normal(size=(240, 16))
    ids = r.integers(0, 80, 240)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = ids.copy()
    for _ in range(240):
        low = np.minimum(low, np.where(near, low[None, :], low.max()).min(axis=1))
    table = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(spark, table, rows_per_list=40, slack=4.0).collect())
    assert got == sorted(zip(ids.tolist(), near.sum(axis=1).tolist(), low.tolist()))


def test_pieces_of_texts_with_the_marker():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        encoder = pieces.Encoder(pieces.parse(f.read()), library)
    r = random.Random(5)
    texts = ["▁▁ ▁ x", " a ▁ ▁ b", "a▁  b", "\n▁▁ \n b", "plain", ""] + ["".join(r.choice("ab ▁ ▁\n.é") for _ in range(r.randrange(40))) for _ in range(500)]
    ids, like, _ = encoder.encode(texts)
    direct = [x.tolist() == library.encode(t) for x, t in zip(ids, texts)]
    assert like == direct and all(direct)


@pytest.mark.parametrize("page,texts", [
    ("<p>hello</p><a " + 'b="x" ' * 10_000, 1), ("<div>" * 10_000 + "x" + "</div>" * 10_000, 1), ("<div>" * 10_000 + "</b></p></i>" * 10_000, 0),
    ("<b>x" * 10_000, 1), ("<li>" + "<div><li>" * 5_000 + "x", 1), ("x > y" + "<a " * 5_000, 1), ("<p>" + "<a b='" * 5_000 + ">z", 1), ("<!--" * 10_000, 0)])
def test_odd_pages_take_no_time(page, texts):
    start = time.time()
    nodes = pages.tree(page)
    pages.decode(nodes, np.ones(len(nodes)))
    assert time.time() - start < 2 and len([v for v in nodes if v.text]) >= texts


def test_an_end_inside_quotes_that_never_close():
    texts = lambda p: [v.text for v in pages.tree(p) if v.text]
    assert texts('<p title="a > b">c</p>') == ["c"]
    assert texts('<p>a</p><a href="x>link</a><p>b</p>') == ["a", "link", "b"]


def line_f1(got, want):
    a, b = got.split("\n"), want.split("\n")
    both = len(set(a) & set(b))
    return 2 * both / max(len(set(a)) + len(set(b)), 1)


def test_articles_without_a_name_are_found(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    seen = table.where("page_id % 2 = 0")
    model = pages.train(seen, sample_pages=120)
    want = {r["page_id"]: r["text"] for r in pages.main_text(spark, table, model).collect()}
    for block in ("<div>", '<div class="kx7">', '<section id="q">'):
        other = table.selectExpr("page_id", "url", f"replace(replace(html, '<article>', '{block}'), '</article>', '</{block[1:].split()[0].rstrip('>')}>') AS html")
        got = {r["page_id"]: r["text"] for r in pages.main_text(spark, other.where("page_id % 2 = 1"), model).collect()}
        assert np.mean([line_f1(t, want[i]) for i, t in got.items()]) >= 0.9, block


def test_stages_keep_columns_of_the_operators_names(spark, tmp_path):
    rows = [(i, f"plain words number {i} make a calm sentence here.", "s0", f"t{i}", i, f"r{i}") for i in range(60)]
    rows += [(i, f"BUY!! NOW!! {i}!! CLICK!! HERE!!", "s0", f"t{i}", i, f"r{i}") for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string, size long, `_rows` string")
    docs = docs.selectExpr("*", "score AS predicted", "size AS taken", "score AS target", "score AS source_size", "score AS `_rest`")
    spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        own = {(r["doc_id"], r["score"], r["size"], r["_rows"], r["predicted"], r["taken"]) for r in out.collect()}
        assert own and own <= {(i, f"t{i}", i, f"r{i}", f"t{i}", i) for i in range(120)}


def test_workers_need_no_package(spark, sf, tmp_path):
    """Tasks of op6 and op9 run where the package can't be imported."""
    import subprocess
    import sys

    program = f"""
import sys
sys.path.insert(0, {str(pipeline.__file__.rsplit('/', 1)[0])!r})
from filinglens.session import get_session
from filinglens.llm import pages, vector_dedup
s = get_session("local[2]", shuffle_partitions=4)
t = s.read.parquet({sf!r} + "/pages.parquet")
print(pages.main_text(s, t, pages.train(t, sample_pages=10, rounds=2, depth=2)).count() >= 0)
print(pages.main_text(s, t, pages.train(t, sample_pages=10, rounds=2, depth=2)).agg(dict(n_chars="sum")).first()[0] >= 0)
print(vector_dedup.near_duplicates(s, s.read.parquet({sf!r} + "/embeddings.parquet")).agg(dict(n_links="sum")).first()[0] >= 0)
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, cwd=tmp_path, timeout=600,
                         env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == ["True"] * 3, out.stderr[-2000:]


def test_crc_of_slots(spark, docs_of):
    out, path, n = shards.write_shards(spark, docs_of([(i, "a b " * (i % 9)) for i in range(200)]), public_tokenizers.path(RANKS), length=8, per_shard=50)
    ids = shards.read_slots(spark, path, 0, n, length=8, per_shard=50)
    assert {r["slot"]: r["ids_crc"] for r in out.collect()} == {i: zlib.crc32(x.tobytes()) for i, x in enumerate(ids)}
    with pytest.raises(ValueError):
        shards.write_shards(spark, docs_of([]), "", per_shard=1 << 17)


def test_chunks_of_production_size_equal_one_encoding():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from filinglens.llm import tokens

    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    counter = tokens.Counter(t)
    parts = ["word ", "it's ", "   ", "\n\n\n", "\t ", "<|endoftext|>", "12345", "日本語", "é", "🙂🙂", "....", "x" * 700, " " * 600, "'ll", "a-b ", "   "]

    @settings(max_examples=40, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(parts), st.integers(1, 400)), min_size=1, max_size=40))
    def check(runs):
        text = "".join(p * n for p, n in runs)
        want = len(t.encode(text, add_special_tokens=False).ids)
        assert tokens.count_spliced(t, text, counter=counter) == want
        assert tokens.count_spliced(t, text, chunk=300, overlap=40, counter=counter) == want
        assert counter.counts([text]) == [want]

    check()


def test_small_chunks_are_packed_against_known_ids():
    r = np.random.default_rng(4)
    phrases = r.integers(0, 50_000, (400, 12)).astype("<u2")
    text = lambda n: phrases[r.integers(0, 400, n)].tobytes()
    known = text(20_000)
    pack, unpack, plain = shards.packer(known), shards.unpacker(known), shards.packer(b"")
    some = [text(100) for _ in range(20)]
    assert [unpack(pack(x)) for x in some] == some
    assert sum(len(pack(x)) for x in some) < 0.6 * sum(len(plain(x)) for x in some)
