"""Operator 13 against a plain alignment of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from filinglens.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world, 12345 tokens!\n\n\tIt's fine.", "日本語のテキストと English mixed テスト。" * 9, "a▁b", "", None, "x", " ", "  lead", "trail  ", "<|endoftext|> and <s> </s> <unk>", "Ünïcödé ﬁligree 🙂🙂 é z",
         "слово за словом " * 40, "aaaaaaaaaaaaaaaa" * 60, "one two three four five six seven " * 90, "\x00\x01 odd ​﻿", "x" * 300 + " " + "y" * 700, "Hello  world, 12345 tokens!\n\n\tIt's fine."]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    docs = []
    for doc, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
            ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xs) == (" " + text).encode() == b"".join(ys):
                i = j = at = to = 0
                gx, gy = [], []
                while i < len(x) or j < len(y):
                    if at <= to and i < len(x):
                        gx, at, i = [*gx, x[i]], at + len(xs[i]), i + 1
                    else:
                        gy, to, j = [*gy, y[j]], to + len(ys[j]), j + 1
                    if at == to:
                        groups.append((gx, gy))
                        gx, gy = [], []
        docs.append((doc, groups))
    held = Counter(pair for _, g in docs for pair in {(p, q) for gx, gy in g for p in gx for q in gy})
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for doc, g in docs:
        links = [(p, q) for gx, gy in g for p in gx for q in gy]
        text = ";".join(",".join(map(str, gx)) + "|" + ",".join(map(str, gy)) for gx, gy in g)
        out.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[q] == top[q[0]] for q in links), sum(held[q] for q in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def test_groups_meet_in_any_order():
    """Any way to compose a text's fragments gives the groups of the whole text."""
    t = align.Tokenizers(A, B)
    r = random.Random(3)
    for text in (x for x in TEXTS if x and "▁" not in x and "\x00" not in x):
        raw = b" " + text.encode()
        ids = t.encode([raw])[0]
        words = align.Words(t)
        want = align.whole_texts(words, [raw])[0]
        safe = [m.end() for m in align.SAFE.finditer(raw)]
        parts = words.ranges([(raw[at:to], at, lo, hi) for lo, hi, at, to in align.spans_of(len(raw), safe, 50)])
        while len(parts) > 1:
            parts[-2:] = [parts[-2].then(t, parts[-1])]
        assert align.columns_of(align.finished(t, parts[0])) == want
        for _ in range(6):
            cuts = sorted({0, len(raw), *(r.randrange(len(raw)) for _ in range(r.randrange(9)))})
            parts = [align.leaf(t, ids, 0, lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i : i + 2] = [parts[i].then(t, align.Fragment.unpacked(parts[i + 1].packed()))]
            assert align.columns_of(align.finished(t, parts[0])) == want


@pytest.mark.parametrize("settings", [{}, {"span": 64, "fan": 3}, {"span": 200, "shared_pairs": 20}, {"shared_pairs": 0}])
def test_against_brute_force(spark, settings):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "x y"), (3, "x y"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pairs", "'z' AS n_a")
    got = sorted(map(tuple, align.align(spark, docs, A, B, **settings).collect()), key=repr)
    assert got == brute(rows)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, align.align(spark, docs, A, B, span=4096).collect()), key=repr)
    assert got == brute(rows)


def test_spans_cover_every_byte_and_stay_short():
    for safe in ([], list(range(7, 1000, 7)), [500], [990]):
        spans = align.spans_of(1000, safe, 64)
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == 1000
        assert all(at <= low and high <= to for low, high, at, to in spans) and sum(to - at for *_, at, to in spans) <= 3000


def test_empty_table(spark):
    assert align.align(spark, spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_pairs_are_put_together_once():
    """Products hold what their factors had; sorting it again for each factor grew with their square."""
    t = align.Tokenizers(A, B)
    raw = b" " + ("one word after another, seven 77 " * 40).strip().encode()
    words = align.Words(t)
    safe = [m.end() for m in align.SAFE.finditer(raw)]
    parts = words.ranges([(raw[at:to], at, lo, hi) for lo, hi, at, to in align.spans_of(len(raw), safe, 100)])
    product = align.composed(t, [f.packed() for f in parts])
    assert len(product.pairs) >= len(parts) and max(map(len, parts[0].pairs)) == 2
    assert align.columns_of(align.finished(t, product)) == align.whole_texts(words, [raw])[0]


def test_places_near_the_cuts_give_the_same_spans():
    rng = random.Random(5)
    for _ in range(300):
        raw = " ".join(rng.choices(["a", "", "\u4e00\u3042", "\u3000", "\n", "e\u0301x" * 30, "\u2581", "7" * 200, "\U0001f642", "\xe9"], k=80)).encode()
        safe = [m.end() for m in align.SAFE.finditer(raw)]
        assert [m.start() for m in align.CUT.finditer(raw)] == safe and align.words_of(raw) == align.SAFE.split(raw)
        for step in (7, 64, 400):
            assert align.spans_of(len(raw), align.near_places(raw, step), step) == align.spans_of(len(raw), safe, step)


def test_words_used_most_are_kept():
    """Too many words: rare ones go, frequent ones need not be encoded again, and nothing changes."""
    t = align.Tokenizers(A, B)
    r = random.Random(8)
    raw = [(" the cat of " + " ".join(f"w{r.randrange(10**6)}{x}" for x in "abcdefghij") + " and the cat sat").encode() for _ in range(60)]
    few, all_words = align.Words(t, most=60), align.Words(t)
    met, meet = [], few.meet
    few.meet = lambda words: (met.extend(words), meet(words))
    got = [x for lo in range(0, 60, 3) for x in align.whole_texts(few, raw[lo : lo + 3])]
    assert got == align.whole_texts(all_words, raw)
    assert len(few.number) <= 60 + 45 and met.count(b" cat") == met.count(b" the") == 1
    assert list(few.number.values()) == list(range(len(few.text))) and len(few.pair) == len(few.times) == few.end[-1]


def test_ranges_are_composed_where_they_are_encoded(spark, monkeypatch):
    """A document of at most ``fan`` ranges leaves the first pass as one row; no table of its ranges' fragments is written."""
    written, staged = [], align.staged

    def counted(spark, df, name, level=3):
        out = staged(spark, df, name, level)
        if name in ("fragments", "aligned-long"):
            written.append(out.count())
        return out

    monkeypatch.setattr(align, "staged", counted)
    rows = [(i, f"document {i} " + "has some words and more " * 30) for i in range(8)] + [(99, "one long text of many ranges " * 400)]
    got = sorted(map(tuple, align.align(spark, spark.createDataFrame(rows, "doc_id long, text string"), A, B, span=100, fan=16).collect()))
    assert got == brute(rows)
    assert written[0] < 30 and sorted(written, reverse=True) == written
