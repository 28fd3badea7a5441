"""Operator 12 against brute force and its SQL's rules on hard rows."""

from itertools import permutations

import duckdb

from filinglens.llm import audit
from filinglens.llm.queries import SQL

LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [(5, "x y", "en", 0), (1, "x y", "en", 0), (1, "x y", "de", 0), (None, "x y", "en", 0), (7, None, None, 1), (8, "", "", 1), (2, LONG, "en", 1), (3, LONG, "fr", 0),
        (4, " ".join(f"w{i}" for i in range(250)), "en", 1), (6, "A" * 40 + " " + " ".join(f"v{i}" for i in range(250)), "fr", 0), (9, "a|b", "de", 0), (9, "a|b", "de", 0), (5, "other", "en", 0)]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (7, None, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1)]


def tables(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string").selectExpr("*", "1 AS bits", "'q' AS part", "2 AS hash", "3 AS n")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' AS part")
    return docs, marks


def brute(rows, labels):
    def fails(i, t):
        words = t.split()
        return {c for c, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                                            any(c in "#$%&*|" for c in t), i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)), strict=True) if x}

    docs = [(lang or "", fails(i, t or ""), any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)) for i, t, lang, _ in rows]
    out = []
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order, 1):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                steps.append([part, "".join(order), k, len(left), len(gone), sum(c in d[0] for d in own) - len(gone), sum(d[0] == {c} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        total = {c: sum(s[4] for s in steps if s[1][s[2] - 1] == c) for c in "ABCDE"}
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_every_order_against_brute_force(spark):
    got = sorted(map(tuple, audit.filter_audit(spark, *tables(spark)).collect()))
    assert got == brute(ROWS, LABELS) and len(got) == 4 * 600


def test_sql_on_the_same_rows(spark):
    docs, marks = tables(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert sorted(con.execute(SQL["op12_filter_audit"].replace("FROM documents", "FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang FROM documents)")).fetchall()) == brute(ROWS, LABELS)


def test_hot_text_is_dealt_over_parts(spark):
    rows = [(i, "same text", "en", 0) for i in range(60)] + [(i, f"text {i}", "en", 0) for i in range(60, 70)]
    docs, _ = tables(spark, rows)
    hashes = docs.selectExpr("doc_id", "md5(text) AS hash")
    out = audit.repeats(spark, docs.selectExpr("doc_id", "text", "md5(text) AS hash"), hashes, copies_per_task=7)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(1, 60))


def test_empty_tables(spark):
    assert audit.filter_audit(spark, *tables(spark, [], [])).count() == 0
    got = sorted(map(tuple, audit.filter_audit(spark, *tables(spark, ROWS, [])).collect()))
    assert got == brute(ROWS, [])
