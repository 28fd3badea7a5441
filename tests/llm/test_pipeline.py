"""Stages of the corpus pipeline against brute force."""

import random

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from filinglens.llm import quality, shingle_join
from filinglens.llm.queries import SQL


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def one_of_near_copies(rows):
    """Distinct (id, text) rows that stay; rows without an id all do."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = [i for i, _ in sets]
    while True:
        new = [min(n for (_, b), n in zip(sets, low) if a == b or a & b and 100 * len(a & b) >= 80 * len(a | b)) if a else i for i, a in sets]
        if new == low:
            break
        low = new
    first = {i for (i, _), n in zip(sets, low) if i == n}
    return sorted({(i, t) for i, t in rows if i in first}, key=repr) + [r for r in rows if r[0] is None]


def near_copies():
    r = random.Random(4)
    rows = []
    for g in range(30):
        words = [f"w{g}x{j}" for j in range(r.choice([8, 30, 100, 240]))]
        for _ in range(4):
            copy = list(words)
            for at in r.sample(range(len(copy)), r.randint(0, max(1, len(copy) // 40))):
                copy[at] = f"n{r.random()}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_copies_of_five_words_and_four_fifths_go(spark, docs_of):
    words = [f"w{i}" for i in range(100)]
    other = [f"new{i}" if i in (30, 70) else w for i, w in enumerate(words)]  # 86 of 106 shingles shared
    rows = [(1000, " ".join(words)), (1001, " ".join(other))] + near_copies()
    rows += [(2000, None), (2001, ""), (None, "a b"), (None, "a b"), (2, rows[4][1]), (2, rows[4][1])]
    docs = docs_of(rows)
    out = pipeline.keep_one_of_near_copies(spark, docs, None)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (1001, rows[1][1]) not in got
    assert sorted(got, key=repr) == sorted(one_of_near_copies(rows), key=repr)
    assert pipeline.keep_one_of_near_copies(spark, docs_of([]), None).count() == 0


def test_signatures_meet_at_four_fifths():
    r = np.random.default_rng(3)
    met = 0
    for _ in range(2000):
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 120))).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.11], r.integers(0, 2**63, int(r.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        keys = [{int(s) for _, _, x, y in shingle_join.signatures(v, 80) for s in (*x, *y)} for v in (a, b)]
        assert keys[0] & keys[1]
        met += 1
    assert met > 100


def test_stages_match_brute_force(spark, tmp_path):
    r = random.Random(6)
    good = [(i, f"plain words number {i} make a calm sentence about item{r.random()} here and there.", f"s{i % 3}") for i in range(100)]
    bad = [(i, f"BUY!! NOW!! {i}!! CLICK!! HERE!!", "s0") for i in range(100, 160)]
    copies = [(200 + i, good[i][1], good[i][2]) for i in range(10)]
    odd = [(300, None, "s1"), (301, "", "s1"), (None, good[20][1], "s2"), (3, good[3][1], "s0"), (4, "another calm sentence with plain words here and there.", "s1")]
    docs = spark.createDataFrame(good + bad + copies + odd, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(160)], "doc_id long, quality int")
    for n, empty in enumerate((False, True)):
        at = str(tmp_path / f"in{n}")
        labels.write.parquet(f"{at}/labels.parquet")
        (docs.limit(0) if empty else docs).write.parquet(f"{at}/documents.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for i, (_, stage) in enumerate(pipeline.STAGES):
            stage(spark, now, at).write.parquet(f"{at}/out{i}")
            before, now = now, spark.read.parquet(f"{at}/out{i}")
            was, got = ([tuple(x) for x in df.collect()] for df in (before, now))
            if i == 0:
                model = quality.fit(before, labels)
                want = [tuple(x)[:3] for x in quality.score_quality(spark, before, model).collect() if x["predicted"] == 1]
                assert empty or {d[0] for d in good} - {x[0] for x in got} == set() and not {x[0] for x in got} & {d[0] for d in bad}
            elif i == 1:
                stay = one_of_near_copies([x[:2] for x in was])
                got = [x[:2] for x in got]
                want = stay
            elif i == 2:
                con = duckdb.connect()
                con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
                if was:
                    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", was)
                taken = {(d, n): t for d, n, _, _, t in con.execute(SQL["op4_mixture"]).fetchall()}
                want = [x for x in was if (n := len((x[1] or "").split())) for _ in range(int(taken[x[0], n] / n + 0.5))]
            else:
                library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
                want = [tuple(library.encode(x[1] or "")) for x in was]
                got = [tuple(x["token_ids"]) for x in now.collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr), i
        whole = pipeline.run(spark, at)
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, now.collect())) and (whole.count() == 0) == empty
