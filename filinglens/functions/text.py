"""String column functions with Python's text semantics, built from native
Spark expressions (no Python worker).

Python's ``str.strip``/``splitlines`` are Unicode-wide while Spark's
``trim`` strips spaces only, so both are spelled out with explicit
character sets here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Python's definitions (str.isspace, str.splitlines)
# ---------------------------------------------------------------------------
# Characters for which str.isspace() is true.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries of str.splitlines() (Java regex).
PY_LINE_BREAK_REGEX = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# HTML named entities decoded by html_to_text (semicolon form). ``&amp;`` is
# always decoded last so that ``&amp;lt;`` yields ``&lt;``.
HTML_ENTITIES = (
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "\xa9"),
    ("&reg;", "\xae"),
    ("&middot;", "\xb7"),
    ("&ndash;", "\u2013"),
    ("&mdash;", "\u2014"),
    ("&lsquo;", "\u2018"),
    ("&rsquo;", "\u2019"),
    ("&ldquo;", "\u201c"),
    ("&rdquo;", "\u201d"),
    ("&hellip;", "\u2026"),
)

# Elements whose text is not part of get_text(): raw-text and template
# content, comments and declarations.
_COMMENT_RE = r"(?s)<!--.*?(?:-->|$)"
_RAW_BLOCK_RE = r"(?is)<{tag}\b[^>]*>(?:.*?</{tag}\s*>|.*)"
_DECL_RE = r"<[!?][^>]*>"
# A start or end tag: '<' or '</' then a letter; a value quoted right after
# '=' may hold '>', any other quote is an ordinary character.
_TAG_RE = r"</?[A-Za-z][^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?[^>=]*+)*+>"

BOILERPLATE_TAGS = ("nav", "header", "footer", "aside")
_AD_BLOCK_RE = r"(?is)<div\b[^>]*\bclass\s*=\s*[\"']?ad[\"']?[^>]*>.*?</div\s*>"


def py_strip(col: Column) -> Column:
    """``str.strip()``: remove Unicode whitespace from both ends."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


def py_splitlines(col: Column) -> Column:
    """``str.splitlines()`` (may keep one trailing empty element)."""
    return F.split(col, PY_LINE_BREAK_REGEX)


def non_blank_lines(col: Column) -> Column:
    """Stripped lines with the blank ones dropped, order kept."""
    return F.filter(F.transform(py_splitlines(col), py_strip), lambda s: s != F.lit(""))


# A character reference as the stdlib HTML parser finds it: a numeric or
# named reference ends at ';' (consumed) or before any other terminating
# character (not consumed); a reference at the very end of the text, with
# nothing after it, is left as text.
_ENTITY_REF_RE = (
    r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)(?:;|(?=[^0-9a-fA-F]))"
    r"|[a-zA-Z][-.a-zA-Z0-9]*(?:;|(?=[^a-zA-Z0-9])))"
)


def _named_entity_table() -> dict[str, str]:
    """Entity name (without ';') -> characters, from Python's HTML5 table;
    the first spelling in sorted order wins."""
    from html.entities import html5

    table: dict[str, str] = {}
    for name, chars in sorted(html5.items()):
        table.setdefault(name[:-1] if name.endswith(";") else name, chars)
    return table


def _cp1252_table() -> dict[int, str]:
    """Bytes 0x80-0x9F that windows-1252 defines (numeric references below
    256 are read as windows-1252)."""
    out = {}
    for b in range(0x80, 0xA0):
        try:
            out[b] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return out


def _code_point_to_string(cp: Column) -> Column:
    # UTF-32BE bytes of the code point decode to the character; numbers that
    # are no character (surrogates, beyond U+10FFFF, overflow) become U+FFFD.
    bad = cp.isNull() | (cp < 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF)
    return F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))


def _numeric_ref(ref: Column) -> Column:
    hexa = F.lower(F.substring(ref, 3, 1)) == F.lit("x")
    digits = F.regexp_extract(ref, r"^&#[xX]?([0-9A-Fa-f]+)", 1)
    cp = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    cp1252 = F.create_map(*[x for b, ch in _cp1252_table().items() for x in (F.lit(b).cast("long"), F.lit(ch))])
    return F.coalesce(F.try_element_at(cp1252, cp), _code_point_to_string(cp))


# Where a reference without ';' ends: a numeric one before any non-hex
# character; a named one before a character that cannot extend the name,
# or (the parser backtracks) before a '-' or '.' that starts the last run of
# name characters at the end of the text.
_NUMERIC_END = r"(?=[^0-9a-fA-F;])"
_NAME_END = r"(?=[^-.a-zA-Z0-9;]|[-.][a-zA-Z0-9]*\z)"

# Stands in for a decoded '&' until every reference is replaced, so decoded
# text is never decoded again (U+FFFF is a noncharacter, absent from text).
_AMP_PLACEHOLDER = "\uffff"


def decode_entities(col: Column) -> Column:
    """Decode character references as the stdlib HTML parser reports them.

    Known names are decoded with or without ';'; an unknown ``&name;``
    becomes ``&name``; numeric references below 256 are read as
    windows-1252. One regex scan collects the distinct references of the
    row, then each is replaced everywhere by a literal ``regexp_replace``
    whose look-ahead matches only whole references (``&copy`` never inside
    ``&copy;`` or ``&copyx``). A decoded '&' is parked as a placeholder until
    the end, so ``&amp;lt;`` yields ``&lt;``.
    """
    full = _named_entity_table()
    # Literal-map lookups scan their keys, so the common names are looked
    # up in a small map first and the full table is consulted only on a miss.
    common = {n: full[n] for n in ["amp"] + [e[1:-1] for e, _ in HTML_ENTITIES] if n in full}
    common_map = F.create_map(*[x for name, ch in common.items() for x in (F.lit(name), F.lit(ch))])
    # the rest of the table as one string "\x01name\x02chars\x01name\x02chars..."
    rest = "".join(f"\x01{name}\x02{ch}" for name, ch in full.items() if name not in common) + "\x01"
    refs = F.array_distinct(F.regexp_extract_all(col, F.lit(_ENTITY_REF_RE), F.lit(0)))

    def step(acc: Column, ref: Column) -> Column:
        numeric = F.substring(ref, 2, 1) == F.lit("#")
        name = F.regexp_extract(ref, r"^&([a-zA-Z][-.a-zA-Z0-9]*)", 1)
        named = F.coalesce(
            F.try_element_at(common_map, name),
            F.nullif(
                F.get(
                    F.regexp_extract_all(
                        F.lit(rest), F.concat(F.lit("\x01\\Q"), name, F.lit("\\E\x02([^\x01]*)")), F.lit(1)
                    ),
                    0,
                ),
                F.lit(""),
            ),
            F.concat(F.lit("&"), name),
        )
        value = F.replace(F.when(numeric, _numeric_ref(ref)).otherwise(named), F.lit("&"), F.lit(_AMP_PLACEHOLDER))
        # a reference without ';' must not be followed by a character that
        # would have extended it (or by the ';' of a different reference)
        tail = F.when(ref.endswith(";"), F.lit("")).otherwise(
            F.when(numeric, F.lit(_NUMERIC_END)).otherwise(F.lit(_NAME_END))
        )
        pattern = F.concat(F.lit("\\Q"), ref, F.lit("\\E"), tail)
        # '\\' and '$' are special in a Java replacement string
        safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(acc, pattern, safe)

    decoded = F.replace(F.aggregate(refs, col, step), F.lit(_AMP_PLACEHOLDER), F.lit("&"))
    return F.when(F.instr(col, "&") > 0, decoded).otherwise(col)


def strip_markup(col: Column) -> Column:
    """Comments, declarations and the content of script/style/template are
    dropped and every tag becomes a line break (entities still encoded)."""
    out = F.regexp_replace(col, _COMMENT_RE, "\n")
    for tag in ("script", "style", "template"):
        out = F.regexp_replace(out, _RAW_BLOCK_RE.format(tag=tag), "\n")
    out = F.regexp_replace(out, _DECL_RE, "\n")
    return F.regexp_replace(out, _TAG_RE, "\n")


def html_to_text(col: Column) -> Column:
    """HTML → text with text nodes separated by newlines."""
    return decode_entities(strip_markup(col))


def strip_boilerplate(col: Column) -> Column:
    """Drop navigation, header, footer, aside and ad blocks from raw HTML."""
    out = col
    for tag in BOILERPLATE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    return F.regexp_replace(out, _AD_BLOCK_RE, "\n")


def html_lines(col: Column) -> Column:
    return non_blank_lines(html_to_text(col))


def normalize_ticker(col: Column) -> Column:
    """One rule everywhere: strip (Unicode) then upper."""
    return F.upper(py_strip(col))


def cik10(col: Column) -> Column:
    """Integer CIK → 10-digit zero-padded string (longer values kept whole)."""
    return F.format_string("%010d", col.cast("long"))


def cik_no_zero(col: Column) -> Column:
    return F.regexp_replace(col, r"^0+", "")


def accession_nodash(col: Column) -> Column:
    return F.replace(col, F.lit("-"), F.lit(""))


def iso_date(col: Column) -> Column:
    """ISO ``YYYY-MM-DD`` text → date; empty/null → null; other text → null."""
    s = F.nullif(col, F.lit(""))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def default_if_blank(col: Column, default: str) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def join_url(base: Column, path: Column) -> Column:
    """``base.rstrip('/') + '/' + path.lstrip('/')``."""
    return F.concat(F.regexp_replace(base, r"/+$", ""), F.lit("/"), F.regexp_replace(path, r"^/+", ""))
