"""Operator 8: token counts with overlap resynchronisation.

A huge text is never encoded at once: overlapping chunks are encoded with
offsets, and two neighbours are spliced at a boundary that both have in their
overlap and that cannot depend on where either chunk was cut. Where there is
none, the overlap is widened until there is one or the text ends.

Why such a boundary is proven: the splitter reads a text from left to right
and looks ahead only, so from any boundary between its words on, what follows
depends on nothing before it. A boundary seen by the earlier chunk is the
whole text's if it lies ``margin`` characters before the chunk's end and the
word that ends there does not touch that margin; if the later chunk has it
too, both go on alike from there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from filinglens.llm.common import renamed, strings

# Fixed value: the words of byte-level vocabularies, as the library splits them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARGIN = 32  # longer than any special string and any look-ahead of the splitter
CHUNK, OVERLAP = 8_192, 512  # characters


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Counter:
    """Token counts of words, each encoded by the library once and remembered
    up to ``most`` words, then anew."""

    def __init__(self, tokenizer, most: int = 400_000):
        self.tokenizer, self.most, self.known = tokenizer, most, {}
        self.words = regex.compile(WORDS)
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(map(regex.escape, special))})") if special else None

    def split(self, text: str) -> list[str]:
        """The words of a text, which cover it without gaps; a special string is one word."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        parts = self.special.split(text)  # every second one is special
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.words.findall(p))]

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.most:
            self.known = {}
        new = list(words.difference(self.known))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[w] = len(e.ids)

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        self.learn({w for words in split for w in words})
        known = self.known.__getitem__
        return [sum(map(known, words)) for words in split]

    def encode(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """Offsets where the words of a chunk begin, its end added, and how
        many of its tokens stand before each."""
        words = self.split(chunk)
        self.learn(set(words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        tokens = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        return np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(tokens)])


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, counter: Counter | None = None) -> int:
    """Tokens of ``text`` as one encoding would give, from chunks."""
    counter = counter or Counter(tokenizer)
    done, start = 0, 0  # tokens counted up to position start, which is a boundary of the whole text
    size = chunk
    while start + size < len(text):
        end = start + size
        places, before = counter.encode(text[start:end])
        wide = overlap
        at = None
        while at is None and wide < size:
            both = np.intersect1d(places + start, counter.encode(text[end - wide : end + MARGIN])[0] + end - wide)
            both = both[(both > max(start, end - wide)) & (both < end - MARGIN)]
            # The last one may end a word that touches the margin only if it is the margin's own; take the one before.
            at = int(both[-2]) if len(both) > 1 else None
            wide *= 2
        if at is None:
            size *= 2  # no boundary in the whole chunk: widen it
            continue
        done += int(before[np.searchsorted(places, at - start)])
        start, size = at, chunk
    return done + int(counter.encode(text[start:])[1][-1])


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every
    row of ``docs``; null text counts as empty, repeated rows each keep a row,
    other columns are not read. One pass without a shuffle; a task's memory is
    bounded by its Arrow batch and one chunk's encoding, whatever a text's
    length. ``path``: a byte-level tokenizer file, readable on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        counter = Counter(tokenizer)
        for b in batches:
            texts = strings(b["text"])
            n = np.zeros(len(texts), dtype=np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for lo in range(0, len(short), 512):
                part = short[lo : lo + 512]
                n[part] = counter.counts([texts[i] for i in part])
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = count_spliced(tokenizer, t, chunk, overlap, counter)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return renamed(docs, doc_id="doc_id", text="text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
