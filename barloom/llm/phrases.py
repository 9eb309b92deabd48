"""Substring dedup with Aho-Corasick automata over repeated phrases.

Recurring passages are confirmed by counted anchors (seeds.py). Their segments come together by
anchor; each shard confirms which windows occur in two or more documents and who has them first,
compiles an automaton of them, and streams every document's segments through it to locate every
occurrence. A word is removed if it lies in a window that also starts in a document of smaller id.

Nulls: a null text has no words; a row with a null doc_id is kept whole and removes nothing. Rows of
equal doc_id remove nothing from each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seeds import RANGES, Unit, apply_ranges, groups, plain, segments

#: Segments that are looked at together: the size of an automaton's shard.
SHARD = 20_000
#: Single letters that stand for words: all code points but surrogates.
LETTERS = 0x110000 - 0x800
_PENDING = "key binary, doc_id long, fp int, start long, first long"


def _letter(n: int) -> str:
    return chr(n if n < 0xD800 else n + 0x800)


def _pair(n: int) -> str:
    """Two letters of ranges that have none in common, so that a match begins at a word."""
    return chr(0x10000 + (n >> 15)) + chr(n & 0x7FFF)


class Shard:
    """Groups of segments: the windows that recur, their first documents, and where they occur."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window = window
        self.group = list(zip(batch.column("h").to_pylist(), batch.column("salt").to_pylist()))
        self.doc, self.fp, self.at = (batch.column(c).to_pylist() for c in ("doc_id", "fp", "at"))
        self.body = batch.column("body").to_pylist()
        # words as letters: an automaton's step is a word; beyond the letters that there are, a word is a pair of them
        cut = {b: b.split(b" ") for b in dict.fromkeys(self.body)}
        order = dict.fromkeys(chain.from_iterable(cut.values()))
        self.width = 1 if len(order) <= LETTERS else 2
        self.number = dict(zip(order, map(_letter if self.width == 1 else _pair, range(len(order)))))
        coded = {b: "".join([self.number[w] for w in words]) for b, words in cut.items()}
        self.code = [coded[b] for b in self.body]
        # the first two documents of each distinct segment of a group; rows come by doc_id
        self.first: dict[tuple[tuple, str], int] = {}
        self.last: dict[tuple[tuple, str], int] = {}
        for g, d, c in zip(self.group, self.doc, self.code):
            self.first.setdefault((g, c), d)
            self.last[g, c] = d
        of_group: dict[tuple, list[str]] = {}
        for g, c in self.first:
            of_group.setdefault(g, []).append(c)
        #: The first document of passages that occur in two or more: whole segments where a group has but one, else windows.
        self.confirmed: dict[str, int] = {}
        for g, own in of_group.items():
            if len(own) == 1:
                lo = self.first[g, own[0]]
                if lo < self.last[g, own[0]]:
                    self._confirm(own[0], lo)
                continue
            for w, (lo, hi) in self.windows(g, own).items():
                if lo < hi:
                    self._confirm(w, lo)
        self.of_group = of_group

    def _confirm(self, passage: str, doc: int) -> None:
        self.confirmed[passage] = min(doc, self.confirmed.get(passage, doc))

    def windows(self, g: tuple, segments: list[str]) -> dict[str, tuple[int, int]]:
        """The first and last document of each window of a group's segments."""
        out: dict[str, tuple[int, int]] = {}
        n = self.window * self.width
        for c in segments:
            lo, hi = self.first[g, c], self.last[g, c]
            for k in range(0, len(c) - n + 1, self.width):
                w = c[k : k + n]
                own = out.get(w)
                out[w] = (lo, hi) if own is None else (min(own[0], lo), max(own[1], hi))
        return out

    def locate(self) -> dict[str, list[tuple[int, int, int]]]:
        """By distinct segment: begin and end of each occurrence of a confirmed passage, with its first document."""
        auto = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for passage, doc in self.confirmed.items():
            auto.add_word(passage, (len(passage) // self.width, doc))
        out: dict[str, list[tuple[int, int, int]]] = {c: [] for c in self.code}
        if len(auto):
            auto.make_automaton()
            for c, hits in out.items():
                hits += [((end + 1) // self.width - n, (end + 1) // self.width, doc) for end, (n, doc) in auto.iter(c)]
                hits.sort()
        return out


def _flagged(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches, SHARD):
        shard = Shard(batch, window)
        hits = shard.locate()
        out: tuple[list, list, list, list] = ([], [], [], [])
        for d, fp, at, c in zip(shard.doc, shard.fp, shard.at, shard.code):
            start = end = -1
            for a, b, lo in hits[c]:
                if lo < d:
                    if at + a > end:
                        if end >= 0:
                            for x, v in zip(out, (d, fp, start, end)):
                                x.append(v)
                        start = at + a
                    end = max(end, at + b)
            if end >= 0:
                for x, v in zip(out, (d, fp, start, end)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "fp", "start", "end"])


def _pending(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of anchors that are dealt over shards: each shard's windows with the places in the shard's first document of each."""
    for batch in groups((b.filter(pc.greater_equal(b.column("salt"), 0)) for b in batches), SHARD):
        shard = Shard(batch, window)
        word, n = {c: w for w, c in shard.number.items()}, shard.width
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        first = {g: shard.windows(g, own) for g, own in shard.of_group.items()}
        for g, d, fp, at, c in zip(shard.group, shard.doc, shard.fp, shard.at, shard.code):
            for k in range(len(c) // n - window + 1):
                w = c[k * n : (k + window) * n]
                if first[g][w][0] == d:
                    key = hashlib.blake2b(b" ".join([word[w[i : i + n]] for i in range(0, len(w), n)]), digest_size=16).digest()
                    for x, v in zip(out, (key, d, fp, at + k, d)):
                        x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "doc_id", "fp", "start", "first"])


def repeated_ranges(docs: DataFrame, window: int = 13, seed: int = 4, limit: int = 2000) -> DataFrame:
    """doc_id, fp, start, end: ranges of words in windows that also start in a document of smaller id; ranges may overlap."""
    unit = Unit(words=True, window=window, seed=seed, texts=True)
    found = segments(docs, unit, limit)
    inside = found.mapInArrow(lambda b: _flagged(b, window), RANGES)
    pending = found.mapInArrow(lambda b: _pending(b, window), _PENDING)
    first = pending.groupBy("key").agg(F.min("first").alias("_first"))
    across = pending.join(first, "key").where("_first < doc_id").select("doc_id", "fp", "start", (F.col("start") + window).alias("end"))
    return inside.unionByName(across)


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = text.split()
    kept, at, removed = [], 0, 0
    for a, b in ranges:
        kept += words[at:a]
        removed += b - a
        at = b
    kept += words[at:]
    return len(words), removed, b" ".join(kept).decode()


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 13, seed: int = 4, limit: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    own = plain(docs, text)
    return apply_ranges(own, repeated_ranges(own, window, seed, limit), ["doc_id", "n_words", "n_removed", "kept"], "doc_id long, n_words long, n_removed long, kept string", _cut)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
