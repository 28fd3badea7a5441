"""Operator 11: personal data by candidates and boosted trees.

Fixed patterns find the base spans. Wider patterns propose overlapping
candidates (written-out addresses, other separators, missing signs); boosted
trees over format and context features score them, and those above a threshold
per kind, calibrated on held-out rows, are added. Only DataFrame functions
run: the trees, fitted on a bounded sample, become CASE expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filinglens.llm.common import renamed, staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns, so written that no text makes them slow: runs are taken
# whole, and a match begins at a run's start or where the last match ended.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|@)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
# The wider patterns; all repetitions are bounded or possessive.
WIDE = (
    rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}+(?:{_DOT}[a-z0-9-]{{1,63}}+){{0,4}}",
    r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    r"(?<![0-9])[0-9](?:[\x20._/ ‐-–-]{0,2}[0-9]){11,18}(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+|00)?[0-9(][0-9()\x20./ ‐-–-]{5,22}[0-9](?![0-9A-Za-z])",
)
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
SPAN = "array<struct<start: bigint, kind: int, end: bigint, s: string, l: string, r: string>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def valid(kind: int, s: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.char_length(digits(s))
    if kind == IP:
        return s.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == CARD:
        return n.between(14, 19) & F.call_function("luhn_check", digits(s))
    return n.between(10, 15) if kind == PHONE else F.lit(True)


def running_sums(x: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs. Blocks of 256 are summed
    on their own, so that no accumulator of a long array is copied for each element."""
    def sums(of: Column, start: Column) -> Column:
        return F.aggregate(of, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(x), F.lit(block)).cast("int")), lambda i: F.slice(x, i * block + 1, block))
    before = sums(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, v: a + v)), zero)
    return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, start: F.slice(sums(b, start), F.lit(2), F.size(b))))


def located(docs: DataFrame, patterns: dict[str, tuple[int, str, Column]]) -> DataFrame:
    """``docs`` with a column of ``SPAN`` per name of ``patterns`` (kind,
    pattern, which texts can hold a match): where the pattern's matches lie,
    in characters, and what stands in the 40 before and 20 after, up to the
    neighbouring matches."""
    none = F.array().cast("array<string>")
    text = F.col("text")
    own = list(docs.columns)
    at = lambda name, i: F.get(name, i)
    x = docs.select("*", *[F.when(can, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_h_{n}") for n, (_, p, can) in patterns.items()],
                    *[F.when(can, F.split(text, p)).otherwise(none).alias(f"_g_{n}") for n, (_, p, can) in patterns.items()])

    def lengths(n: str) -> Column:
        return F.transform(f"_h_{n}", lambda _, i: (F.char_length(at(f"_g_{n}", i)) + F.when(i > 0, F.char_length(at(f"_h_{n}", i - 1))).otherwise(0)).cast("long"))

    x = x.select("*", *[lengths(n).alias(f"_n_{n}") for n in patterns])
    x = x.select("*", *[F.when(F.size(f"_n_{n}") > 0, running_sums(F.col(f"_n_{n}"))).alias(f"_s_{n}") for n in patterns])

    def spans(n: str, kind: int) -> Column:
        def one(h: Column, i: Column) -> Column:
            start = at(f"_s_{n}", i)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(h)).alias("end"), h.alias("s"),
                            F.right(at(f"_g_{n}", i), F.lit(40)).alias("l"), F.left(at(f"_g_{n}", i + 1), F.lit(20)).alias("r"))

        return F.transform(f"_h_{n}", one)

    return x.select(*own, *[spans(n, kind).alias(n) for n, (kind, _, _) in patterns.items()])


def spans_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Written: a row number, doc_id, base spans and candidates of each row."""
    d = renamed(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at, digit = F.col("_at"), F.col("_digit")
    d = d.select("*", F.col("text").contains("@").alias("_at"), F.col("text").rlike("[0-9]").alias("_digit"), F.col("text").rlike(r"(?i)[\s\[({<]dot[\s\])}>]").alias("_dot"),
                 F.col("text").rlike("[0-9A-Fa-f:]:[0-9A-Fa-f]").alias("_colon"))
    can = (at, digit, digit, F.col("text").contains("+"))
    wide = (at | F.col("_dot"), digit | F.col("_colon"), digit, digit)
    x = located(d, {f"base{k}": (k, BASE[k], can[k]) for k in range(4)} | {f"wide{k}": (k, WIDE[k], wide[k]) for k in range(4)})

    def good(k: int) -> Column:
        return F.filter(f"base{k}", lambda s: valid(k, s["s"])).cast(SPAN)

    base = F.array_sort(F.concat(*[good(k) for k in range(4)]))
    candidates = F.concat(*[F.col(f"wide{k}").cast(SPAN) for k in range(4)])
    out = x.select("doc_id", base.alias("base"), candidates.alias("candidates")).withColumn("row", F.monotonically_increasing_id())
    return staged(spark, out, "spans")


def features() -> dict[str, Column]:
    """Format and context of a span, from the columns kind, s, l and r."""
    s, left, right = F.col("s"), F.lower("l"), F.lower("r")
    d, low = digits(s), F.lower("s")
    n = F.char_length(d)
    words = lambda side, w: side.rlike(rf"(?:^|[^a-z])(?:{w})(?![a-z])")
    yes = {f"is_{k}": F.col("kind") == i for i, k in enumerate(KINDS)} | {
        "plus": s.startswith("+"), "double_zero": s.startswith("00"), "brackets": s.rlike(r"^\+?[0-9]{0,3}\x20?\([0-9]{2,5}\)"), "luhn": (n >= 12) & F.call_function("luhn_check", d),
        "card_start": d.rlike("^(?:3[0-9]|4|5[0-9]|6)"), "fours": s.rlike(r"^[0-9]{4}(?:\D{1,2}[0-9]{4}){2}"), "local": s.rlike(r"^(?:\+?1\D)?\(?[2-9][0-9]{2}\)?\D{1,2}[0-9]{3}\D[0-9]{4}$"),
        "even_separators": s.rlike(r"^[0-9]+(?:(\D{1,2})[0-9]+(?:\1[0-9]+)*)?$"), "parts": s.rlike(rf"^{PART}(?:\D{{1,7}}{PART}){{3}}$"), "date": s.rlike(r"^(?:1[89]|20)[0-9]{2}\D+[01]?[0-9]\D+[0-3]?[0-9]\b|^[0-3]?[0-9]\D+[01]?[0-9]\D+(?:1[89]|20)[0-9]{2}\b"),
        "years": s.rlike(r"^(?:1[89]|20)[0-9]{2}\D+(?:1[89]|20)[0-9]{2}$"), "book": d.rlike("^97[89][0-9]{10}$"), "clock": s.rlike("^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})+$"),
        "hardware": s.rlike("^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), "hex_groups": s.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), "gap_colons": s.contains("::"), "sign_at": s.contains("@"),
        "bracket_at": low.rlike(r"[\[({<]\s?(?:at|@)"), "word_at": low.rlike(r"\sat\s"), "dotted": low.rlike(r"\.|dot"), "known_end": low.rlike(r"(?:\W|^)(?:com|org|net|edu|gov|info|io|[a-z]{2})$"),
        "glued_left": left.rlike(r"[a-z0-9_=/#\"'+.,:$€£-]$"), "glued_right": right.rlike(r"^[a-z0-9_=/#\"'%€£-]"), "says_phone": words(left, "phone|tel|telephone|call|mobile|cell|fax|sms|whatsapp|dial"),
        "says_card": words(left, "card|visa|mastercard|amex|credit|debit|payment|pay"), "says_mail": words(left, "mail|e-mail|email|contact|write|reach|address"),
        "says_host": words(left, "ip|ipv4|ipv6|host|server|client|from|address|peer|remote"),
        "says_other": words(left, "order|invoice|isbn|version|sha|key|token|serial|id|no|nr|number|ref|item|page|section|year|total|price|cost|amount|usd|eur"),
    }
    # Sizes tell something of numbers only; elsewhere they'd single out the examples.
    numeric = F.col("kind").isin(CARD, PHONE)
    numbers = {"n_digits": n, "length": F.char_length(s), "n_runs": F.size(F.split(s, r"[^0-9]+")), "n_different": F.size(F.array_distinct(F.split(d, ""))),
               "n_dots": F.char_length(F.regexp_replace(s, r"[^.]+", ""))}
    numbers = {k: F.when(numeric, v).otherwise(0) for k, v in numbers.items()} | {"end_letters": F.char_length(F.regexp_extract(s, "([A-Za-z]*)$", 1))}
    return {k: v.cast("double") for k, v in (yes | numbers).items()}


def examples(spans: DataFrame, per_kind: int, seed: int) -> DataFrame:
    """Labelled rows (kind, s, l, r, label, fold, weight): base spans of the table and
    built-in ones rewritten in other formats (1) or damaged (0), and candidates of documents without base spans (0).

    The spans are chosen in one pass and written (at most ``per_kind`` of each kind and the built-in ones), and
    each takes all its forms in one projection: a plan holds the long expressions once, not once for every form."""
    spark = spans.sparkSession
    written = {
        EMAIL: "jane.doe@example.com sam@uni-town.edu info@shop.co.uk k.lee99@post.net ana@firma.de x_y@data.io paul@paper.org mia.b@town.gov lu@garden.fr desk@north.example.com max@window.es ivy@river.com",
        IP: "192.0.2.17 198.51.100.8 203.0.113.250 10.1.0.3 172.16.254.1 8.8.4.4",
        CARD: "4111111111111111 5555555555554444 4012888888881881 5105105105105100 6011111111111117 30569309025904",
        PHONE: "+12025550143 +442079460958 +13035559911 +493012345678 +33142685300 +16175550187",
    }
    seeds = [(k, s) for k, all_of in written.items() for s in all_of.split()]
    seen = spans.select(F.explode("base").alias("b")).select("b.kind", "b.s", "b.l", "b.r").distinct()
    order = F.xxhash64(F.lit(seed), "s", "l", "r")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(order, "s", "l", "r"))  # a bound: cut in each task before the shuffle
    taken = seen.withColumn("_place", place).where(F.col("_place") <= per_kind).drop("_place")
    taken = staged(spark, taken.unionAll(spark.createDataFrame([(k, s, " my own is ", " as ever ") for k, s in seeds], "kind int, s string, l string, r string")), "example-spans")
    s, d = F.col("s"), digits(F.col("s"))
    user, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    lit, last = F.lit, F.right(d, F.lit(1))
    wrong = F.concat(F.expr("left(regexp_replace(s, '[^0-9]+', ''), length(regexp_replace(s, '[^0-9]+', '')) - 1)"), F.pmod(last.cast("int") + 3, lit(10)).cast("string"))
    by = lambda x, sizes, sep: F.regexp_replace(x, "^" + "".join(f"([0-9]{{{n}}})" for n in sizes) + "([0-9]*)$", sep.join(f"${i + 1}" for i in range(len(sizes) + 1)))
    ten, h = F.right(d, lit(10)), F.md5("s")
    four = lambda sep: by(d, (4, 4, 4), sep)
    hexes = [F.substring(h, 4 * i + 1, 4) for i in range(8)]
    two = [F.substring(h, 2 * i + 1, 2) for i in range(6)]
    clock = [F.lpad(F.pmod(F.xxhash64(lit(i), "s"), lit(m)).cast("string"), 2, "0") for i, m in enumerate((24, 60, 60))]
    year = F.concat(lit("19"), F.lpad(F.pmod(F.xxhash64("s"), lit(100)).cast("string"), 2, "0"))
    far = F.replace(F.regexp_replace(s, "[0-9]+$", "921"), lit("."), lit("[.]"))
    variants = {
        EMAIL: [(1, s), (1, F.concat(user, lit(" (at) "), F.replace(host, lit("."), lit(" (dot) ")))), (1, F.concat(user, lit("[at]"), F.replace(host, lit("."), lit("[dot]")))),
                (1, F.concat(user, lit(" at "), F.replace(host, lit("."), lit(" dot ")))), (1, F.concat(user, lit("(at)"), host)), (1, F.concat(user, lit(" [AT] "), host)),
                (0, F.concat(user, lit("@"), F.substring_index(host, ".", 1))), (0, F.concat(lit("look at the"), lit(" dot "), F.substring_index(host, ".", 1))),
                (0, F.concat(user, lit(" at "), F.substring_index(host, ".", 1))), (0, F.concat(user, lit(" at "), F.substring_index(host, ".", 1), lit(".")))],
        IP: [(1, s), (1, F.replace(s, lit("."), lit("[.]"))), (1, F.replace(s, lit("."), lit("(.)"))), (1, F.replace(s, lit("."), lit(" [.] "))), (1, F.concat_ws(":", *hexes)), (1, F.concat_ws(":", *hexes[:3], lit("0000"), lit("0000"), *hexes[5:])),
             (1, F.concat_ws(":", lit("2001"), F.right(hexes[1], lit(3)), hexes[2], lit("0"), lit("0"), F.right(hexes[3], lit(3)), F.right(hexes[4], lit(2)), hexes[5])),
             (1, F.concat(hexes[0], lit(":"), hexes[1], lit("::"), hexes[2])),
             (1, F.concat(lit("fe80::"), hexes[3], lit(":"), hexes[4])), (0, F.concat_ws(":", *clock)), (0, F.concat_ws(":", *two)), (0, far), (0, F.concat(lit("::"), F.substring(h, 1, 1))), (0, F.concat_ws(":", clock[0], clock[1], lit("7")))],
        CARD: [(1, s), (1, d), (1, four(".")), (1, four("/")), (1, four("  ")), (1, four("_")), (1, four("–")), (1, four(" ")), (0, wrong), (0, by(wrong, (4, 4, 4), " ")), (0, by(wrong, (4, 4, 4), ".")), (0, by(wrong, (4, 4, 4), "-")),
               (0, by(wrong, (4, 4, 4), "_")), (0, F.left(d, lit(12))), (0, by(F.left(d, lit(12)), (4, 4), "-"))],
        PHONE: [(1, s), (1, by(ten, (3, 3), "-")), (1, F.concat(lit("("), F.left(ten, lit(3)), lit(") "), by(F.right(ten, lit(7)), (3,), "-"))), (1, by(ten, (3, 3), ".")), (1, by(ten, (3, 3), " ")), (1, F.concat(lit("1-"), by(ten, (3, 3), "-"))),
                (1, F.concat(lit("00"), d)), (1, F.concat(lit("001 "), by(ten, (3, 3), " "))), (0, ten), (0, F.right(d, lit(7))), (0, F.concat(year, lit(" - "), lit("2004"))), (0, F.concat_ws("-", year, lit("05"), clock[0])), (0, F.concat_ws(".", clock[0], lit("11"), year)),
                (0, F.concat(F.left(ten, lit(4)), lit("."), F.right(ten, lit(4)))), (0, F.concat(lit("978-3-"), F.left(ten, lit(2)), lit("-"), F.right(ten, lit(6)), lit("-1"))), (0, F.concat_ws(" ", F.left(ten, lit(2)), F.right(ten, lit(3)), lit("12"), lit("7"))),
                (0, by(ten, (1, 2, 2, 1, 1), " "))],
    }
    made = F.lit(None)
    for k, rows in variants.items():
        made = F.when(F.col("kind") == k, F.array(*[F.struct(lit(y).alias("label"), x.alias("s")) for y, x in rows])).otherwise(made)
    new = taken.select("kind", "l", "r", F.col("s").alias("of"), F.explode(made).alias("v")).select("kind", "v.s", "l", "r", "v.label", "of").where("s <> ''")
    # In other company: phrases that tell of the kind, and of another thing.
    said = F.get(F.array(*[F.lit(x) for x in ("e-mail: ", "the server at ip ", "paid by card ", "phone ")]), F.col("kind"))
    label, number = F.col("label"), F.col("kind").isin(CARD, PHONE)
    # A card is no phone number and a phone number no card.
    forms = [(lit(True), F.col("kind"), F.col("l"), label), (label == 1, F.col("kind"), said, label),
             ((F.col("kind") == PHONE) & F.col("s").rlike("^[0-9]{10}$"), F.col("kind"), lit("please call "), lit(1)),
             (label == 0, F.col("kind"), lit("order no "), label), (number, CARD + PHONE - F.col("kind"), F.col("l"), lit(0))]
    forms = F.array(*[F.struct(fits.alias("fits"), k.alias("kind"), left.alias("l"), y.alias("label")) for fits, k, left, y in forms])
    rows = new.select("s", "r", "of", F.inline(forms)).where("fits")
    # Text without personal data, as far as the base patterns can tell: it may
    # hold some in other formats, so it weighs less and calibrates nothing.
    quiet = spans.where(F.size("base") == 0).select(F.explode("candidates").alias("c")).select("c.kind", "c.s", "c.l", "c.r").distinct()
    quiet = quiet.orderBy(order, "s", "l", "r", "kind").limit(4 * per_kind).select("kind", "s", "l", "r", F.lit(0.0).alias("label"), F.lit(1).cast("long").alias("fold"), F.lit(0.25).alias("weight"))
    rows = rows.select("kind", "s", "l", "r", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(seed + 1), "of"), F.lit(4)).alias("fold"), F.lit(1.0).alias("weight"))
    return rows.unionAll(quiet)


@dataclass
class Trees:
    """Boosted trees over ``features()``: nodes are (feature, threshold, low,
    high) or a leaf's value; ``thresholds``: the least score of each kind."""

    trees: list
    thresholds: list[float]

    def score(self) -> Column:
        """The probability, from the features' columns."""
        names = list(features())

        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, limit, low, high = node
            return F.when(F.col(names[at]) <= limit, value(low)).otherwise(value(high))

        margin = reduce(Column.__add__, [value(t) * w for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * margin))


def node_of(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), node_of(node.leftChild()), node_of(node.rightChild())


def fit(spans: DataFrame, per_kind: int = 100, rounds: int = 10, depth: int = 4, precision: float = 0.98, seed: int = 11) -> Trees:
    """Trees fitted on examples made from at most ``per_kind`` base spans of
    each kind and four times as many other candidates. Of the former a quarter is held out: a kind's
    threshold is the least (of at least a half) from which on held-out rows are right in ``precision`` of the cases."""
    spark = spans.sparkSession
    names = list(features())
    # Written, so that the features are over columns and not over what makes the examples.
    rows = staged(spark, examples(spans, per_kind, seed).distinct(), "example-rows").select("*", *[v.alias(k) for k, v in features().items()])
    rows = staged(spark, rows.select("kind", "label", "fold", "weight", array_to_vector(F.array(*names)).alias("features"), *names).repartition(1).sortWithinPartitions("kind", "fold", "weight", "label", *names), "examples")
    model = GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed).fit(rows.where("fold > 0"))
    trees = Trees([(w, node_of(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)], [0.5] * 4)
    held = rows.where("fold = 0").select("kind", "label", trees.score().alias("score")).collect()  # a quarter of a bounded sample
    for k in range(4):
        own = sorted(((r["score"], r["label"]) for r in held if r["kind"] == k and r["score"] >= 0.5), reverse=True)
        ends = {score: i for i, (score, _) in enumerate(own, 1)}  # rows of this score and above
        good = [score for score, i in ends.items() if sum(y for _, y in own[:i]) >= precision * i]
        trees.thresholds[k] = min(good, default=0.5 if not own else 1.0)
    return trees


def find(spark: SparkSession, docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans
    (kind:start:end, base ones and those added) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans (the hash is that of an empty text). Rows
    that repeat an id or a text each keep a row. Texts are scanned whole, in time in
    proportion to their length. An added span overlaps no base span; of added ones that
    overlap in a chain, the best scored stays (ties: the longer, the earlier, the first kind).
    Base spans of different kinds may overlap. Other columns are not read.
    """
    spans = spans_of(spark, docs)
    model = fit(spans, **fitting)
    cast = F.get(F.array(*[F.lit(float(t)) for t in model.thresholds]), F.col("kind"))
    found = spans.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    # Written, so that the trees' expression is over columns and not over their regexes.
    found = staged(spark, found.select("row", "kind", "start", "end", *[v.alias(k) for k, v in features().items()]), "candidates")
    found = found.select("row", "kind", "start", "end", model.score().alias("score")).where(F.col("score") >= cast)
    known = spans.where(F.size("base") > 0).select("row", F.explode("base").alias("b")).select("row", "b.kind", "b.start", "b.end", F.lit(None).cast("double").alias("score"))
    both = found.unionAll(known)
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind", F.isnull("score"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    is_base = F.col("score").isNull()
    free = both.withColumn("_until", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("_from", F.min(F.when(is_base, F.col("start"))).over(after))
    free = free.where(~is_base & (F.coalesce("_until", F.lit(0)) <= F.col("start")) & (F.coalesce("_from", F.col("end")) >= F.col("end")))
    chain = free.withColumn("_new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    chain = chain.withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct("score", F.col("end") - F.col("start"), -F.col("start"), -F.col("kind"))
    best = chain.groupBy("row", "_chain").agg(F.max_by(F.struct("start", "kind", "end"), rank).alias("b"))
    added = best.groupBy("row").agg(F.collect_list("b").alias("added"))

    flat = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    name = lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    written = lambda x: F.array_join(F.transform(F.array_sort(x), name), ",")
    of_kind = lambda i: lambda b: b["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    out = spans.join(added, "row", "left")
    everything = F.concat(flat, F.coalesce("added", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")))
    return out.select("doc_id", *counts, F.sha2(written(flat), 256).alias("base_sha256"), written(everything).alias("spans"))
