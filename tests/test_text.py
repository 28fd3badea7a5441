"""Text chain: Python string semantics, HTML to lines, sections, chunking."""

import random

from pyspark.sql import functions as F

from filinglens.functions.text import html_to_text, non_blank_lines, py_strip
from filinglens.operators.chunking import chunk_array, split_sections
from filinglens.options import Options


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col(F.col("v")).alias("r")).first()["r"]


def python_chunks(text, max_chars=2000, overlap=200, sep="\n"):
    """Plain restatement of the greedy paragraph fold (test oracle)."""
    paras = [p.strip() for p in text.split(sep) if p.strip()]
    out, cur = [], ""
    for p in paras:
        if len(cur) + len(p) + 2 > max_chars and cur:
            out.append(cur.strip())
            cur = cur[-overlap:] if overlap > 0 else ""
        cur += ("\n\n" if cur else "") + p
    if cur:
        out.append(cur.strip())
    return out


def python_sections(lines):
    import re

    head = re.compile(r"item\s+(\d+[A-Z]?)\.\s*(.+)", re.IGNORECASE)
    out, cur, name, item = [], [], "Unknown", None
    for line in lines:
        m = head.match(line)
        if m:
            if cur:
                out.append((item, name, "\n".join(cur)))
                cur = []
            item, name = m.group(1), m.group(2)
        else:
            cur.append(line)
    if cur:
        out.append((item, name, "\n".join(cur)))
    return out


def test_strip_matches_python(spark):
    samples = [" a ", " x　", "\x1c y \x1f", "  z ", "", "  ", "a b"]
    df = spark.createDataFrame([(s,) for s in samples], "v string").select(py_strip(F.col("v")).alias("r"))
    assert [r["r"] for r in df.collect()] == [s.strip() for s in samples]


def test_lines_match_python_splitlines(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i\n\n  j  \n"
    got = one(spark, non_blank_lines, text)
    assert got == [x.strip() for x in text.splitlines() if x.strip()]


def test_html_to_text_cases(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T &amp; C</title><style>p{x:1}</style>"
        "<script>var t=\"</p>\";</script></head><body><p title=\"a>b\">Hello&nbsp;<b>world</b></p>"
        "<!-- hidden --><p>x &lt; y &#169; &#x41;</p>a < b<template><p>no</p></template></body></html>"
    )
    lines = one(spark, lambda c: non_blank_lines(html_to_text(c)), html)
    assert lines == ["T & C", "Hello", "world", "x < y © A", "a < b"]


def test_sections_cases(spark):
    lines = [
        "preamble",
        "Item 2.",  # no text after the dot: body text
        "ITEM 1a. Risk",
        "risk body",
        "Item\u00a02. MD&A",  # non-breaking space counts as whitespace
        "Item 3. Empty",  # heading followed by heading: no section
        "Item 4. Controls",
        "item 6 Exhibits",  # no dot: body text
        "Item 4. Controls",
        "again",
    ]
    df = spark.createDataFrame([(1, lines)], "id int, lines array<string>")
    got = [(r.section_item, r.section_name, r.text) for r in split_sections(df, "lines", Options(), ["id"]).orderBy("section_order").collect()]
    assert got == python_sections(lines)
    assert got[0] == (None, "Unknown", "preamble\nItem 2.")


def test_sections_random_against_restatement(spark):
    rnd = random.Random(7)
    docs = []
    for d in range(60):
        ls = []
        for _ in range(rnd.randint(0, 30)):
            r = rnd.random()
            if r < 0.25:
                ls.append(f"Item {rnd.randint(1, 9)}{rnd.choice(['', 'A', 'b'])}. Name {rnd.randint(0, 3)}")
            else:
                ls.append(" ".join(rnd.choice(["x", "yy", "zzz"]) for _ in range(rnd.randint(1, 5))))
        docs.append((d, ls))
    df = spark.createDataFrame(docs, "id int, lines array<string>")
    rows = split_sections(df, "lines", Options(), ["id"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.section_order, (r.section_item, r.section_name, r.text)))
    for d, ls in docs:
        mine = [x for _, x in sorted(got.get(d, []))]
        assert mine == python_sections(ls)


def test_chunker_random_against_restatement(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(150):
        paras = []
        for _ in range(rnd.randint(0, 25)):
            n = rnd.choice([1, 5, 40, 300, 900, 2500])
            paras.append(" " * rnd.randint(0, 2) + "w" * n + " " * rnd.randint(0, 2))
        texts.append("\n".join(paras))
    for mx, ov, sep in [(2000, 200, "\n"), (500, 50, "\n"), (2000, 200, "\n\n"), (300, 0, "\n")]:
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(chunk_array(F.col("t"), mx, ov, sep).alias("c"))
        got = [r["c"] for r in df.collect()]
        assert got == [python_chunks(t, mx, ov, sep) for t in texts]


def test_chunker_edges(spark):
    # one paragraph longer than max stays whole; blank text gives no chunk
    got = spark.createDataFrame([("x" * 2500,), ("   \n  ",)], "t string").select(chunk_array(F.col("t"), 2000, 200, "\n").alias("c")).collect()
    assert [len(c) for c in got[0]["c"]] == [2500]
    assert got[1]["c"] == []


def test_random_unicode_strip_and_lines(spark):
    from filinglens.functions.text import PY_WHITESPACE

    rnd = random.Random(3)
    alphabet = list(PY_WHITESPACE) + list("abcXYZ \u00e9\u00df\u4e2d\u00a0\u3000\r\n-.") + ["\ufeff", "\u200b"]
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, v string")
    got = {r.i: (r.s, r.l) for r in df.select("i", py_strip(F.col("v")).alias("s"), non_blank_lines(F.col("v")).alias("l")).collect()}
    for i, s in enumerate(samples):
        assert got[i][0] == s.strip(), repr(s)
        assert got[i][1] == [x.strip() for x in s.splitlines() if x.strip()], repr(s)


def test_character_references_like_the_stdlib_parser(spark):
    from filinglens.functions.text import decode_entities

    cases = {
        "a &amp;lt; &quot;x&quot; &#169;&#x41; &#36;1 &#92;n &bogus; &copy;&amp; end": 'a &lt; "x" ©A $1 \\n &bogus ©& end',
        "&copy 2024 AT&T &ampx &#150; &#x81; &#169a &#0; x": "© 2024 AT&T &ampx – \x81 &#169a \x00 x",
        "tail &amp": "tail &amp",
        "&#38;amp; &#99999999999999999999; &#xD800;.": "&amp; � �.",
        "&amp;#38; &#38; &copy;&copy &copy-x &copy.": "&#38; & ©© &copy-x ©.",
        "&copy.x": "©.x",
        "&copy-x;": "&copy-x",
        "&lt&gt;": "<>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r.h: r.d for r in df.select("h", decode_entities(F.col("h")).alias("d")).collect()}
    assert got == cases


def test_a_quote_in_an_unquoted_value_swallows_no_text(spark):
    from pyspark.sql import functions as F

    from filinglens.functions.text import html_to_text

    df = spark.createDataFrame([("<p>it's <a href=x'y>link</a> don't</p><i a=\"1>2\" b='>'>x</i>",)], "h string")
    text = df.select(html_to_text(F.col("h"))).first()[0]
    assert text.split() == ["it's", "link", "don't", "x"]
