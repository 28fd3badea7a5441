"""Operator 13: alignment of two tokenizers by an associative fragment monoid.

Both tokenizers cut the same bytes; the offsets where a token of each ends cut
them into groups. A byte range of a document yields a fragment: an open prefix
(tokens up to the first common end), closed groups, and an open suffix (tokens
after the last common end). Fragments of neighbouring ranges compose
associatively: some neighbouring ranges are encoded and composed by one task, and
the products of a long document's tasks are reduced as a tree. A short document is one fragment.

Links' ids are counted over all documents. The most frequent pairs (a bounded
list) are looked up in every task; the rest, whose counts are small, are joined.
"""

from __future__ import annotations

import contextlib
import hashlib
import pickle
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from filinglens.llm.common import renamed, staged
from filinglens.llm.pieces import threads

# A space between two characters that are no white space (some other
# characters are left out too): no token of either kind spans its start.
_LEFT = (rb"[\x21-\x7e]", rb"[\xc3-\xdf][\x80-\xbf]", rb"[\xe0\xe4-\xee][\x80-\xbf]{2}", rb"\xe3[\x81-\xbf][\x80-\xbf]", rb"[\xf0-\xf4][\x80-\xbf]{3}")
_NEXT = rb"(?:[\x21-\x7e\xc3-\xe0\xe4-\xee\xf0-\xf4]|\xe3[\x81-\xbf])"
_RIGHT = b" " + _NEXT
SAFE = re.compile(b"(?=" + _RIGHT + b")(?:" + b"|".join(b"(?<=" + x + b")" for x in _LEFT) + b")")
# The same spaces, themselves matched: the search goes from space to space and not from byte to byte.
CUT = re.compile(b" (?=" + _NEXT + b")(?:" + b"|".join(b"(?<=" + x + b" )" for x in _LEFT) + b")")
# A word that may stand between any two others, with a safe place on each side.
JOINS = re.compile(_RIGHT + b"(?s:.*)(?:" + b"|".join(b"(?<=" + x + b")" for x in _LEFT) + b")")
WIDE_GROUP = 4096  # links; in wider groups equal ids are counted first


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # Ranges can be encoded alone if no piece spans the start of a space run.
        self.by_range = not any(re.search("[^▁]▁", p) for p in pieces)
        self.width = len(pieces).bit_length()  # a pair of ids is a << width | b
        self.offset = 2 * len(names)
        self.spelling = [f"{i}{c}" for i in range(len(names)) for c in ",|"] + [f"{i}{c}" for i in range(len(pieces)) for c in ",;"]

    def encode(self, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both kinds for texts that begin with a space, which the
        second tokenizer adds by itself; None where the tokens' bytes differ."""
        texts = [r.decode() for r in raw]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        same = [b"".join(map(of_a, x)) == r == b"".join(map(of_b, y)) for x, y, r in zip(a, b, raw, strict=True)]
        return [(np.array(x, np.int64), np.array(y, np.int64)) if ok else None for x, y, ok in zip(a, b, same, strict=True)]


def words_of(raw: bytes) -> list[bytes]:
    """``raw`` cut at all safe places."""
    first, *rest = CUT.split(raw)
    return [first, *[b" " + w for w in rest]]


def near_places(raw: bytes, step: int) -> list[int]:
    """Of the safe places the last before or at, and the first after, each
    multiple of ``step``: all that ``spans_of`` looks at."""
    out = set()
    for at in range(step, len(raw), step):
        back, found = 64, []
        while not found:
            found = [m.start() for m in CUT.finditer(raw, max(0, at - back), at + 3) if m.start() <= at]
            if back >= at:
                break
            back *= 8
        out.update(found[-1:])
        if after := CUT.search(raw, at + 1):
            out.add(after.start())
    return sorted(out)


def spans_of(n: int, safe: list[int], step: int) -> list[tuple[int, int, int, int]]:
    """(low, high, from, to): byte ranges [low, high) of n bytes, about ``step``
    long, with the safe places around each between which it is encoded. One
    cut at most falls between two safe places, so all spans are 3 n at most."""
    places = np.array([0, *safe, n])
    cuts = np.arange(step, n, step)
    gap = np.searchsorted(places, cuts, side="right")
    cuts = [0, *cuts[np.unique(gap, return_index=True)[1]].tolist(), n]
    out = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        i, j = np.searchsorted(places, low, side="right") - 1, np.searchsorted(places, high)
        out.append((low, high, int(places[i]), int(places[j])))
    return out


@dataclass
class Tokens:
    """A run of tokens of both kinds: ids, and the offsets where they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, more: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), more.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def between(self, low: int | None, high: int | None) -> Tokens:
        """Tokens that end after ``low`` and not after ``high``."""
        def cut(end: np.ndarray) -> slice:
            return slice(0 if low is None else np.searchsorted(end, low, side="right"), len(end) if high is None else np.searchsorted(end, high, side="right"))

        ca, cb = cut(self.a_end), cut(self.b_end)
        return Tokens(self.a[ca], self.a_end[ca], self.b[cb], self.b_end[cb])


def pairs_of(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links per group, and (group, pair, how often) of linked ids. ``ga``,
    ``gb``: the groups 0 to n - 1 of the tokens, ascending."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    links = na * nb
    wide = np.flatnonzero(links > WIDE_GROUP)
    reps = np.where(links[ga] > WIDE_GROUP, 0, nb[ga])
    left = np.repeat(np.arange(len(a)), reps)
    right = (np.cumsum(nb) - nb)[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
    group, pair, times = [ga[left]], [a[left] << width | b[right]], [np.ones(len(left), np.int64)]
    for g in wide.tolist():
        xa, ca = np.unique(a[slice(*np.searchsorted(ga, [g, g + 1]))], return_counts=True)
        xb, cb = np.unique(b[slice(*np.searchsorted(gb, [g, g + 1]))], return_counts=True)
        pair.append((xa[:, None] << width | xb).ravel())
        times.append((ca[:, None] * cb).ravel())
        group.append(np.full(len(pair[-1]), g))
    return links, np.concatenate(group), np.concatenate(pair), np.concatenate(times)


def summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (owner, pair) once, ``times`` added; sorted."""
    if not len(pair):
        return owner, pair, times
    key = owner << 40 | pair  # a pair has less than 40 bits
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, np.diff(key) != 0))
    return key[first] >> 40, key[first] & (1 << 40) - 1, np.add.reduceat(times[order], first)


def spelled(t: Tokenizers, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
    """The tokens of all groups as text (ids with the sign after each) and
    where each group begins in that list."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    start = np.concatenate([[0], np.cumsum(na + nb)])
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = 2 * a + np.append(np.diff(ga) != 0, True)[: len(a)]
    out[np.arange(len(b)) + np.cumsum(na)[gb]] = t.offset + 2 * b + np.append(np.diff(gb) != 0, True)[: len(b)]
    return list(map(t.spelling.__getitem__, out.tolist())), start


@dataclass
class Fragment:
    """``suffix`` is None while no common end is known: all tokens are in
    ``prefix`` then. The closed part is kept as its groups' text, counts and pairs:
    lists of what the factors had, put together once at the end (``whole``)."""

    ok: bool
    prefix: Tokens
    suffix: Tokens | None = None
    groups: tuple[str, ...] = ()
    n_groups: int = 0
    n_links: int = 0
    n_a: int = 0
    n_b: int = 0
    pairs: tuple[tuple[np.ndarray, np.ndarray], ...] = ()  # (pair, how often)

    def whole(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The groups' text, and the pairs, each once, with how often they stand."""
        if not self.pairs:
            return "".join(self.groups), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        if len(self.pairs) > 1:
            _, pair, times = summed(np.zeros(len(pair), np.int64), pair, times)
        return "".join(self.groups), pair, times

    def packed(self) -> bytes:
        """Plain values only: workers that have no copy of this class read them."""
        tokens = self.prefix.parts(), self.suffix and self.suffix.parts()
        return pickle.dumps((self.ok, *tokens, self.n_groups, self.n_links, self.n_a, self.n_b, ("".join(self.groups),), self.pairs))

    @staticmethod
    def unpacked(raw: bytes) -> Fragment:
        ok, prefix, suffix, *counts, groups, pairs = pickle.loads(raw)
        return Fragment(ok, Tokens(*prefix), suffix and Tokens(*suffix), groups, *counts, pairs)

    def close(self, t: Tokenizers, run: Tokens, common: np.ndarray) -> None:
        """Appends the groups of ``run``, cut at the offsets ``common``, the last of which ends it."""
        ga, gb = np.searchsorted(common, run.a_end), np.searchsorted(common, run.b_end)
        links, group, pair, times = pairs_of(run.a, ga, run.b, gb, len(common), t.width)
        self.groups += ("".join(spelled(t, run.a, ga, run.b, gb, len(common))[0]),)
        self.n_groups += len(common)
        self.n_links += int(links.sum())
        self.n_a += len(run.a)
        self.n_b += len(run.b)
        _, pair, times = summed(np.zeros(len(pair), np.int64), pair, times)
        self.pairs += ((pair, times),)

    def then(self, t: Tokenizers, right: Fragment) -> Fragment:
        """This fragment followed by ``right``: associative."""
        out = Fragment(self.ok and right.ok, self.prefix)
        if not out.ok:
            return Fragment(False, NO_TOKENS)
        seam = (self.prefix if self.suffix is None else self.suffix) + right.prefix
        common = np.intersect1d(seam.a_end, seam.b_end, assume_unique=True)
        if self.suffix is not None:
            out.groups, out.n_groups, out.n_links, out.n_a, out.n_b = self.groups, self.n_groups, self.n_links, self.n_a, self.n_b
            out.pairs = self.pairs
            low = None
        elif not len(common):
            # Where ``right`` is closed, the other kind's token up to its first common end began further left.
            return replace(right, prefix=seam)
        else:
            low, common = common[0], common[1:]
            out.prefix = seam.between(None, low)
        if len(common):
            out.close(t, seam.between(low, common[-1]), common)
        if right.suffix is None:
            out.suffix = seam.between(common[-1] if len(common) else low, None)
            return out
        out.groups += right.groups
        out.n_groups, out.n_links, out.n_a, out.n_b = out.n_groups + right.n_groups, out.n_links + right.n_links, out.n_a + right.n_a, out.n_b + right.n_b
        out.pairs += right.pairs
        out.suffix = right.suffix
        return out


NO_TOKENS = Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


def leaf(t: Tokenizers, ids: tuple[np.ndarray, np.ndarray] | None, at: int, low: int, high: int) -> Fragment:
    """The fragment of the tokens that start in [low, high), out of those
    encoded from offset ``at`` on."""
    if ids is None:
        return Fragment(False, NO_TOKENS)
    kept = []
    for x, size in zip(ids, (t.a_len, t.b_len), strict=True):
        end = at + np.cumsum(size[x])
        here = slice(*np.searchsorted(end - size[x], [low, high]))
        kept += [x[here], end[here]]
    return Fragment(True, NO_TOKENS).then(t, Fragment(True, Tokens(*kept)))


def finished(t: Tokenizers, f: Fragment) -> Fragment:
    """A whole document's: its begin closes the prefix, its end the suffix."""
    return Fragment(f.ok, NO_TOKENS, NO_TOKENS).then(t, f)


ROW = "row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
EMPTY = (0, 0, 0, 0, "", b"", b"")


def columns_of(f: Fragment) -> tuple:
    if not f.n_groups:
        return EMPTY
    groups, pair, times = f.whole()
    return f.n_a, f.n_b, f.n_groups, f.n_links, hashlib.sha256(groups[:-1].encode()).hexdigest(), pair.astype("<i8").tobytes(), times.astype("<i4").tobytes()


def composed(t: Tokenizers, packed: list[bytes]) -> Fragment:
    """The product of fragments that follow each other."""
    out, *rest = map(Fragment.unpacked, packed)
    for f in rest:
        out = out.then(t, f)
    return out


class Words:
    """Fragments of words, which lie between two safe places and so are closed
    at both ends, each computed once while remembered, and their products. Of more than ``most``
    short words those used most stay."""

    def __init__(self, t: Tokenizers, most: int = 150_000):
        self.t, self.most = t, most
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}  # in the order of the numbers
        self.text: list[str] = []
        self.size = 0  # of the words and their texts
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether the tokens spell the word
        self.pair, self.times, self.end, self.uses = (np.zeros(0, np.int64) for _ in range(4))

    def thin(self) -> None:
        """Forgets all but the words used most, of equal ones the last: at most half of what may be remembered."""
        order = np.lexsort((np.arange(len(self.uses)), self.uses))[::-1]
        size = np.fromiter(map(len, self.number), np.int64, len(order)) + np.fromiter(map(len, self.text), np.int64, len(order))
        order = order[: self.most // 2]
        keep = np.sort(order[np.cumsum(size[order]) <= self.most * 100])
        held = np.diff(self.end, prepend=0)[keep]
        at = np.repeat(self.end[keep] - np.cumsum(held), held) + np.arange(held.sum())
        words = list(self.number)
        self.number = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.text = [self.text[i] for i in keep.tolist()]
        self.size = int(size[keep].sum())
        self.counts, self.uses = self.counts[keep], self.uses[keep] // 2
        self.pair, self.times, self.end = self.pair[at], self.times[at], np.cumsum(held)

    def meet(self, words: list[bytes]) -> None:
        """Computes the fragments of new words. Many are encoded as one text,
        end to end, as they'd stand in a document; all are one run of groups."""
        joined, alone = [], []
        for w in words:
            (joined if JOINS.fullmatch(w) else alone).append(w)
        texts = [joined[i : i + 400] for i in range(0, len(joined), 400)] + [[w] for w in alone]
        ids = self.t.encode([b"".join(x) for x in texts])
        for i in [i for i, x in enumerate(ids) if x is None and len(texts[i]) > 1]:  # some word isn't spelt by its tokens
            texts += [[w] for w in texts[i]]
            ids += self.t.encode(texts[i])
            texts[i] = []
        good = [(x, y) for x, y in zip(texts, ids, strict=True) if x and y is not None]
        words = [w for x, _ in good for w in x]
        n = len(words)
        counts, text, held = np.zeros((n, 5), np.int64), [], np.zeros(n, np.int64)
        pair = times = np.zeros(0, np.int64)
        if good:
            a, b = (np.concatenate([y[k] for _, y in good]) for k in (0, 1))
            a_end, b_end = np.cumsum(self.t.a_len[a]), np.cumsum(self.t.b_len[b])
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            ga, gb = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
            links, group, pair, times = pairs_of(a, ga, b, gb, len(common), self.t.width)
            ends = np.cumsum([0, *map(len, words)])
            of_a, of_b, cut = (np.searchsorted(x, ends, side="right") for x in (a_end, b_end, common))
            word, pair, times = summed(np.searchsorted(cut[1:], group, side="right"), pair, times)
            names, start = spelled(self.t, a, ga, b, gb, len(common))
            total = np.concatenate([[0], np.cumsum(links)])
            counts = np.column_stack([np.diff(of_a), np.diff(of_b), np.diff(cut), np.diff(total[cut]), np.ones(n, np.int64)])
            places = start[cut].tolist()
            text = ["".join(names[lo:hi]) for lo, hi in zip(places[:-1], places[1:], strict=True)]
            held = np.bincount(word, minlength=n)
        bad = [w for x, y in zip(texts, ids, strict=True) if y is None for w in x]
        words, text = words + bad, text + [""] * len(bad)
        counts, times_of = np.concatenate([counts, np.zeros((len(bad), 5), np.int64)]), np.concatenate([held, np.zeros(len(bad), np.int64)])
        before = self.end[-1] if len(self.end) else 0
        self.number.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        self.text += text
        self.size += sum(map(len, words)) + sum(map(len, text))
        self.counts = np.concatenate([self.counts, counts])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        self.end = np.concatenate([self.end, before + np.cumsum(times_of)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def products(self, texts: list[list[bytes]]) -> list[Fragment]:
        """The closed fragment of each text, given as its words."""
        if len(self.number) > self.most or self.size > self.most * 200:
            self.thin()
        new = list(set().union(*texts).difference(self.number))
        if new:
            self.meet(new)
        ids = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]
        sizes = np.array([len(x) for x in ids], np.int64)
        every, doc = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.repeat(np.arange(len(ids)), sizes)
        self.uses += np.bincount(every, minlength=len(self.uses))
        doc, word, n = summed(doc, every, np.ones(len(every), np.int64))
        held = np.diff(self.end, prepend=0)[word]
        at = np.repeat(self.end[word] - held - (np.cumsum(held) - held), held) + np.arange(held.sum())
        owner, pair, times = summed(np.repeat(doc, held), self.pair[at], self.times[at] * np.repeat(n, held))
        cut = np.searchsorted(owner, np.arange(len(ids) + 1))
        out = []
        for k, x in enumerate(ids):
            c = self.counts[x]
            if not c[:, 4].all():
                out.append(Fragment(False, NO_TOKENS))
                continue
            n_a, n_b, n_groups, n_links = c[:, :4].sum(axis=0).tolist()
            part = slice(cut[k], cut[k + 1])
            out.append(Fragment(True, NO_TOKENS, NO_TOKENS, ("".join(map(self.text.__getitem__, x.tolist())),), n_groups, n_links, n_a, n_b, ((pair[part], times[part]),)))
        return out

    def ranges(self, places: list[tuple[bytes, int, int, int]]) -> list[Fragment]:
        """The fragments of [low, high) of texts of which ``raw``, from offset
        ``at`` on, begins and ends at safe places: its outer words may be cut."""
        words = [words_of(raw) for raw, *_ in places]
        first = self.t.encode([x[0] for x in words])
        last = self.t.encode([x[-1] if len(x) > 1 else b"" for x in words])
        inner = self.products([x[1:-1] for x in words])
        out = []
        for x, a, b, c, (raw, at, low, high) in zip(words, first, last, inner, places, strict=True):
            f = leaf(self.t, a, at, low, high)
            if len(x) > 2:
                f = f.then(self.t, c)
            out.append(f.then(self.t, leaf(self.t, b, at + len(raw) - len(x[-1]), low, high)) if len(x) > 1 else f)
        return out


@contextlib.contextmanager
def words_kept(path_a: str, path_b: str) -> Iterator[Words]:
    """The words of this worker process, which its later tasks find again. A
    task takes them out and puts them back at its end, so none that broke off is used again."""
    # Functions are pickled by value: the globals of this module are new in each task.
    kept = sys.modules.setdefault("_filinglens_kept", types.ModuleType("_filinglens_kept")).__dict__
    key = f"{path_a}\n{path_b}"
    w = kept.pop(key, None) or Words(Tokenizers(path_a, path_b))
    yield w
    kept[key] = w


def whole_texts(w: Words, raw: list[bytes]) -> list[tuple]:
    """``columns_of`` the fragments of texts (each begins with the space in front)."""
    return [columns_of(f) for f in w.products([words_of(r) if r else [] for r in raw])]


def aligned(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, span: int, fan: int) -> tuple[DataFrame, str]:
    """A written table of ``ROW`` for every row of ``docs``, and doc_id's type."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        threads()
        row = TaskContext.get().partitionId() << 33
        with words_kept(path_a, path_b) as w:
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    part = batch.slice(lo, 128)
                    raw = [b" " + x.encode() if x else b"" for x in part["text"].to_pylist()]
                    cuts = [spans_of(len(r), near_places(r, span), span) if w.t.by_range and len(r) > span else [] for r in raw]
                    done = whole_texts(w, [b"" if len(c) > 1 else r for r, c in zip(raw, cuts, strict=True)])
                    rows, size = [], 0
                    for r, doc_id, own, spans in zip(raw, part["doc_id"].to_pylist(), done, cuts, strict=True):
                        if len(spans) < 2:
                            rows.append((row, doc_id, *own, None, None, None, None, None, None))
                        for no, (low, high, at, to) in enumerate(spans if len(spans) > 1 else []):
                            rows.append((row, doc_id, *own, no, len(spans), low, high, at, r[at:to]))
                            size += to - at
                            if size > 1 << 21:
                                yield table(rows)
                                rows, size = [], 0
                        row += 1
                    yield table(rows)

    schema = ROW.format(kind) + ", no int, n int, low long, high long, at long, bytes binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple], arrow: pa.Schema = arrow) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    out = staged(spark, renamed(docs, doc_id="doc_id", text="text").mapInArrow(read, schema), "aligned")
    names = [x.split()[0] for x in ROW.split(", ")]
    whole, parts = out.where("no IS NULL").select(*names), out.where("no IS NOT NULL")
    most = parts.agg(F.max("no")).first()[0]
    if most is None:
        return whole, kind

    def product(t: Tokenizers, row: int, doc_id, no: int, n: int, out: Fragment) -> tuple:
        """Fragment ``no`` of the ``n`` that are left of a document, the only one as its row."""
        done = columns_of(finished(t, out)) if n == 1 else [None] * len(EMPTY)
        return row, doc_id, *done, no, n, None if n == 1 else out.packed()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges, in order, as fragments, and up to ``fan`` neighbours as one: only products leave the task."""
        threads()
        with words_kept(path_a, path_b) as w:
            key = out = None  # the product that is being put together
            rows, size = [], 0
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    p = b.slice(lo, 64)
                    row, doc_id, no, n, *places = (p[c].to_pylist() for c in ("row", "doc_id", "no", "n", "bytes", "at", "low", "high"))
                    for *now, f in zip(row, doc_id, (x // fan for x in no), (-(-x // fan) for x in n), w.ranges(list(zip(*places, strict=True))), strict=True):
                        if now == key:
                            out = out.then(w.t, f)
                            continue
                        if key is not None:
                            rows.append(product(w.t, *key, out))
                            size += sum(len(x) for x in rows[-1] if isinstance(x, (bytes, str)))
                        key, out = now, f
                        if size > 1 << 22:
                            yield table(rows, shape)
                            rows, size = [], 0
            if key is not None:
                rows.append(product(w.t, *key, out))
            yield table(rows, shape)

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        """Neighbours as one fragment; a document's last ones as its row."""
        with words_kept(path_a, path_b) as w:
            p = p.sort_values("no")
            row, doc_id, no, n, _ = p.iloc[0]
            return pd.DataFrame([product(w.t, row, doc_id, no // fan, -(-n // fan), composed(w.t, p["fragment"]))], columns=[*names, "no", "n", "fragment"])

    products = ROW.format(kind) + ", no int, n int, fragment binary"
    shape = to_arrow_schema(StructType.fromDDL(products))
    up = F.floor(F.col("no") / fan).alias("_up")
    # Neighbours meet in one task, those of a longer document in many.
    level = parts.repartition(F.col("row"), up).sortWithinPartitions("row", "no").mapInArrow(encode, products)
    while True:
        level = staged(spark, level, "aligned-long")
        whole = whole.unionAll(level.where("n = 1").select(*names))
        most //= fan
        if not most:
            break
        level = level.where("n > 1").select("row", "doc_id", "no", "n", "fragment").groupBy("row", up).applyInPandas(compose, products)
    return whole, kind


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, documents) of a task's rows, added up before they are sent."""
    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "documents"])

    held, size = [], 0
    for b in batches:
        held.append(np.frombuffer(b"".join(b["pairs"].to_pylist()), "<i8"))
        size += len(held[-1])
        if size > 8_000_000:
            yield from sent(held)
            held, size = [], 0
    yield from sent(held)


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, span: int = 8192, fan: int = 16, shared_pairs: int = 400_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of
    every row of ``docs`` (doc_id, text).

    ``path_a``: a byte-level model of the tokenizers library, ``path_b``: one of
    SentencePiece; executors read both. Null and empty texts, and those whose
    tokens don't spell a space and the text (a text with U+2581, say), have zeros and an empty
    hash. Rows that repeat an id each count as a document and keep a row. Texts of more than
    ``span`` bytes are encoded in ranges of that length, ``fan`` neighbours by one task, and their
    products reduced ``fan`` at a time; where no safe place to cut is near, ranges are
    longer. At most ``shared_pairs`` pairs of ids, the most frequent, go to every
    task; the others are joined, so no key of that join has many rows. Other columns are not read.
    """
    rows, kind = aligned(spark, docs, path_a, path_b, span, fan)
    width = Tokenizers(path_a, path_b).width
    counts = staged(spark, rows.select("pairs").mapInArrow(document_counts, "pair long, documents long").groupBy("pair").agg(F.sum("documents").alias("documents")), "pair-counts")
    best = counts.groupBy(F.shiftright("pair", width).alias("_a")).agg(F.max("documents").alias("_best"))
    counts = counts.withColumn("_a", F.shiftright("pair", width)).join(best, "_a").select("pair", "documents", (F.col("documents") == F.col("_best")).alias("best"))
    counts = staged(spark, counts, "pair-counts-best")
    # Pairs by size class, a few dozen rows, to choose how many are shared.
    classes = counts.groupBy(F.floor(F.log2("documents") * 8).alias("size")).agg(F.count("*").alias("n"), F.min("documents").alias("least")).orderBy(F.desc("size")).collect()
    held, least = 0, None
    for c in classes:
        held += c["n"]
        if held > shared_pairs:
            break
        least = c["least"]
    common = counts.where(F.col("documents") >= least) if least is not None else counts.limit(0)
    top = common.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "documents", "best")))
    everything = held <= shared_pairs

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, documents, best = shared.value
        for b in batches:
            raw, n = b["pairs"].to_pylist(), b["times"].to_pylist()
            x, n = np.frombuffer(b"".join(raw), "<i8"), np.frombuffer(b"".join(n), "<i4").astype(np.int64)
            row = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
            at = np.minimum(np.searchsorted(pair, x), max(len(pair) - 1, 0))
            met = pair[at] == x if len(pair) else np.zeros(len(x), bool)
            at, here = at[met], row[met]
            total, top = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            np.add.at(total, here, n[met] * documents[at])
            np.add.at(top, here, n[met] * best[at])
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[~met], minlength=len(raw)))])
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v[~met], pa.int64())) for v in (x, n)]
            names = [*given, "n_best", "count_sum", "rest_pairs", "rest_times"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in given), pa.array(top), pa.array(total), *lists], names=names)

    given = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    shape = ROW.format(kind).replace("pairs binary, times binary", "n_best long, count_sum long, rest_pairs array<long>, rest_times array<long>")
    out = rows.mapInArrow(look_up, shape)
    final = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if everything:
        return out.select(*final)
    out = staged(spark, out, "aligned-common")
    rest = out.where(F.size("rest_pairs") > 0).select("row", F.explode(F.arrays_zip("rest_pairs", "rest_times")).alias("_r"))
    rest = rest.select("row", F.col("_r.rest_pairs").alias("pair"), F.col("_r.rest_times").alias("_n")).join(counts, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("_n") * F.col("documents")).alias("_sum"), F.sum(F.col("_n") * F.col("best").cast("int")).alias("_best"))
    joined = out.join(rest, "row", "left")
    joined = joined.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return joined.select(*final)
