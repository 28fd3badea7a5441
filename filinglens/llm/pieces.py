"""Operator 5: SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here; the normaliser, the marker for
spaces, the scores (unigram) or merges (BPE) and the byte fallback are rebuilt
as a tokenizers pipeline. All ids are compared with the SentencePiece library's,
and decoded again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filinglens.llm.common import renamed, strings

# Field numbers and kinds of the model's protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7)
        n = varint() if n is None else n
        yield key >> 3, raw[at : at + n]
        at += n


def parse(raw: bytes) -> Model:
    m = Model()
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            score = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
            m.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.trim_spaces, m.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, the best-scored piece first."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    out = []
    for p, score, kind in m.pieces:
        if kind == NORMAL:
            out += [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [x[3:] for x in sorted(out)]


def build(m: Model, prefix: bool = True):
    """The model as a tokenizers pipeline; ``prefix``: for whole texts, with
    the marker the model puts in front, else for parts of a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    if m.kind == BPE:
        t = Tokenizer(models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges(m), unk_token=m.pieces[unk][0],
                                 fuse_unk=True, byte_fallback=m.byte_fallback))
    elif m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], unk, m.byte_fallback))
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim_spaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if m.dummy_prefix and prefix else back)
    return t


class Encoder:
    """Encodes and decodes batches and compares with the library.

    No id spans two characters that stand side by side in no piece. Where
    no piece joins a character and a following marker, or holds a line end,
    texts fall apart at the start of each space run and at line ends; each
    such word is then encoded, decoded and compared once, many to a line-ended
    chunk (at most ``most`` are remembered). Texts that hold the marker itself,
    which the library's pieces may join across a word's start, and other
    models get whole texts."""

    def __init__(self, m: Model, library, most: int = 150_000, chunk: int = 400):
        joined = [p for p, _, kind in m.pieces if kind in (NORMAL, USER) and re.search(f"[^{MARK}]{MARK}|\n", p)]
        plain = not m.charsmap and not m.trim_spaces and m.dummy_prefix and m.escape_spaces
        self.by_word = m.kind == BPE and m.byte_fallback and not joined and plain
        self.tokenizer, self.parts, self.library = build(m), build(m, prefix=False), library
        self.line_end = self.tokenizer.token_to_id("<0x0A>")
        self.most, self.chunk = most, chunk
        self.word = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.lossy: set[str] = set()  # words that decode to something else
        self.unlike: set[str] = set()  # words the library encodes otherwise

    def meet(self, words: list[str]) -> None:
        """Encodes words: chunks of them, each behind a line end."""
        ends = [w for w in words if w[0] == "\n"]
        self.known.update((w, np.full(len(w), self.line_end, "<i4").tobytes()) for w in ends)
        words = [w for w in words if w[0] != "\n"]
        groups = [words[i : i + self.chunk] for i in range(0, len(words), self.chunk)]
        texts = ["\n" + "\n".join(g) for g in groups]
        for g, e, theirs in zip(groups, self.parts.encode_batch_fast(texts, add_special_tokens=False), self.library.encode(texts, num_threads=1), strict=True):
            ids = np.array(e.ids, dtype="<i4")
            cut = np.append(np.flatnonzero(ids == self.line_end), len(ids)).tolist()
            raw = ids.tobytes()
            self.known.update((w, raw[4 * i + 4 : 4 * j]) for w, i, j in zip(g, cut[:-1], cut[1:], strict=True))
            back = self.parts.decode(e.ids, skip_special_tokens=False).split("\n")[1:]
            if back != g:
                self.lossy.update(w for w, x in zip(g, back, strict=True) if w != x)
            if e.ids != theirs[1:]:  # theirs begins with the marker of its text
                self.unlike.update(w for w in g if self.library.encode("\n" + w)[2:] != np.frombuffer(self.known[w], "<i4").tolist())

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Of each text its ids, whether they are the library's, and whether
        they decode to the (normalised) text. Compared are the whole texts, or
        all words of which a text is made."""
        apart = [self.by_word and MARK not in t for t in texts]
        some = lambda own: [t for t, a in zip(texts, apart, strict=True) if a is own]
        by = {own: zip(*run(some(own)), strict=True) for own, run in ((False, self.whole), (True, self.by_words))}
        out = [next(by[a]) for a in apart]
        return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

    def whole(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        if texts:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            like = [x == y for x, y in zip(ids, self.library.encode(texts, num_threads=1), strict=True)]
            trip = [x == self.library.normalize(t) or x == t for x, t in zip(back, texts, strict=True)]
            return [np.array(x, dtype="<i4") for x in ids], like, trip
        return [], [], []

    def by_words(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        if len(self.known) > self.most:
            self.forget()
        split = [self.word.findall(" " + t) if t else [] for t in texts]  # the marker in front is a space
        self.meet(list(set().union(*split).difference(self.known)))
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, words)), "<i4") for words in split]
        like = [self.unlike.isdisjoint(words) for words in split] if self.unlike else [True] * len(split)
        trip = [self.lossy.isdisjoint(words) for words in split] if self.lossy else [True] * len(split)
        return out, like, trip


def threads() -> None:
    """The library's threads: as many as Spark gives the task cores."""
    from pyspark import TaskContext

    c = TaskContext.get()
    cpus = int(c.cpus()) if c else 1
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if cpus > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(cpus))


def encode_pieces(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc (crc32 of the ids as little-endian int32),
    parity (the SentencePiece library gives the same ids: compared on the whole
    text where it holds the marker or the model can't be split at words, else on each
    of its words), round_trip (decoding gives the normalised text back; not
    where a text holds the marker itself) and, with ``keep_ids``, token_ids, for
    every row of ``docs``. Null text counts as empty: no ids, both checks true.
    Repeated rows each keep a row; other columns are not read. One pass, no
    shuffle. ``path``: the model file, readable on executors."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc long, parity boolean, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        threads()
        with open(path, "rb") as f:
            m = parse(f.read())
        encoder = Encoder(m, sentencepiece.SentencePieceProcessor(model_file=path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, like, trip = encoder.encode(strings(part["text"]))
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                cols = [part["doc_id"], pa.array(sizes), pa.array(crc, pa.int64()), pa.array(like, pa.bool_()), pa.array(trip, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_crc", "parity", "round_trip"]
                if keep_ids:
                    cut = np.concatenate([[0], np.cumsum(sizes)])
                    cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(ids))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return renamed(docs, doc_id="doc_id", text="text").mapInArrow(run, schema + (", token_ids array<int>" if keep_ids else ""))
