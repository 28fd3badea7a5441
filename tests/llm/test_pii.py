"""Operator 11: base spans against Python's patterns, added spans by case."""

import hashlib
import re

import pytest

from filinglens.llm import pii


def luhn(d):
    return sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


HARD = ["a@b.c%x@d.e, a@b.c..x@d.e x@y @z.com a@@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 00001.0.0.0255", "4111 1111-1111 1111 and 4111111111111112, 5 5 5", "+1 234 567 8901) ++12 3456789012 +1", None, "",
        "é" * 50 + " +1 (743) 555-3824 🙂 x@y.zz", "9" * 5000 + " " + "a" * 20000 + "@", "1 " * 3000, "+" * 4000 + "1.1.1.1", "+1 202 555 0143 4111111111111111"]
ADDED = {  # text: what is added
    "call me on 202-555-0143 today": ["phone:11:23"],
    "write to jane (at) corp (dot) org soon": ["email:9:33"],
    "the host 2001:db8:85a3:0000:0000:8a2e:0370:7334 answers": ["ip:9:47"],
    "was paid by card 4111.1111.1111.1111 at noon": ["card:17:36"],
}
CLEAN = ["in 1999-2004, on 2021-05-17 at 12:34:56, look at the dot here", "order no 123456789012, version 1.2.3, 3.14159265358979 and 00:1a:2b:3c:4d:5e", "x 4111.1111.1111.1112 y", "ISBN 978-3-16-148410-0"]


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate([*HARD, *ADDED, *CLEAN])) + [(1, HARD[0]), (1, HARD[0]), (None, "me@home.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS kind", "'x' AS base", "6 AS row", "7 AS s", "8 AS score")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "0", "''", "0", "0", "0")
    docs = docs.unionAll(given)
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], pii.find(spark, docs).collect()


def test_base_spans(found):
    rows, out = found
    want = [(i, *[sum(x[1] == k for x in base(t)) for k in range(4)], hashlib.sha256(written(base(t)).encode()).hexdigest()) for i, t in rows]
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted(want, key=repr)
    assert len([r for r in out if r["n_phone"]]) > 3


def test_spans_hold_the_base_and_no_added_one_overlaps(found):
    rows, out = found
    texts = dict(rows)
    for r in out:
        if r["doc_id"] in (None, 1):
            continue
        own = base(texts[r["doc_id"]])
        every = [x.split(":") for x in r["spans"].split(",") if x]
        every = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in every]
        assert every == sorted(every) and set(own) <= set(every)
        for a, k, b in set(every) - set(own):
            assert all(b <= x or y <= a for x, j, y in every if (x, j, y) != (a, k, b))


def test_added_and_clean(found):
    rows, out = found
    spans = {t: r["spans"] for r in out for i, t in rows if i == r["doc_id"] and i is not None and i >= len(HARD)}
    for text, want in ADDED.items():
        assert spans[text].split(",") == want, text
    for text in CLEAN:
        assert spans[text] == "", (text, spans[text])


def test_added_in_unmarked_documents_are_few(found):
    rows, out = found
    quiet = [r for r in out if r["doc_id"] is not None and r["doc_id"] >= 1000 and not any((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]))]
    assert len(quiet) > 100 and sum(r["spans"] != "" for r in quiet) <= 0.02 * len(quiet)


def test_running_sums(spark):
    rows = spark.range(1).selectExpr("transform(sequence(1, 1000), x -> cast(x AS bigint)) AS a")
    assert rows.select(pii.running_sums(rows["a"]).alias("s")).first()["s"] == [i * (i + 1) // 2 for i in range(1, 1001)]


def test_empty_table(spark):
    assert pii.find(spark, spark.createDataFrame([], "doc_id long, text string"), rounds=2).count() == 0


def test_examples_take_all_their_forms_in_one_projection(spark):
    docs = spark.createDataFrame([(1, "a@b.org, +1 202 555 0143 and 8.8.4.4"), (2, "pay 4111 1111 1111 1111"), (3, "call 202-555-0143")], "doc_id long, text string")
    rows = pii.examples(pii.spans_of(spark, docs), 2, 11)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate ") <= 4
    got = {(r["kind"], r["s"], r["l"], r["label"]) for r in rows.collect()}
    assert {(pii.EMAIL, "a (at) b (dot) org", "", 1.0), (pii.EMAIL, "a@b", "order no ", 0.0), (pii.PHONE, "2025550143", "please call ", 1.0), (pii.PHONE, "2025550143", "order no ", 0.0),
            (pii.PHONE, "4111111111111111", "pay ", 0.0), (pii.CARD, "4111111111111111", "paid by card ", 1.0), (pii.PHONE, "202-555-0143", "call ", 0.0)} <= got
