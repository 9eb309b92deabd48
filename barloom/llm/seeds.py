"""Candidate repeats by sampled seeds, shared by the two substring operators.

A text is a sequence of units, words or bytes. Of the seeds (runs of `seed` units) inside a window of
`window` units, the one of least hash is the window's anchor. Equal windows have equal anchors, so
windows need comparing only where their anchors agree, and windows under an anchor that occurs once
need no comparing at all. Neighbouring windows share an anchor: a run of them is a segment.

Anchors are counted with map-side sums. An anchor of more than `limit` segments is dealt over several
shards (salts) by text; what shards of one anchor must compare with each other, the operators do by
finer keys that equal windows share as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .columnar import text_bytes, text_slices
from .workspace import small_batches, written


@dataclass(frozen=True)
class Unit:
    """What windows are made of. An anchor recurs if it stands in two texts where `texts`, else in two places."""

    words: bool
    window: int
    seed: int
    texts: bool


class Windows:
    """The windows of a batch of texts: anchors, which of them lie in one text, and the units' bounds."""

    def __init__(self, texts: pa.Array, unit: Unit):
        self.raw, offsets = text_bytes(texts)
        if unit.words:
            self.start, self.end, self.first = rolling.words(self.raw, offsets)
            self.hashes = rolling.Segments(rolling.word_hashes(self.raw, self.start, self.end))
        else:
            self.first = offsets
            self.hashes = rolling.Segments(self.raw)
        self.seeds = self.hashes.windows(unit.seed)
        self.anchor = rolling.sliding_min(self.seeds, unit.window - unit.seed + 1)
        self.ok = rolling.within(self.first, unit.window)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))[: len(self.anchor)]

    def anchors(self, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and text of each anchor, and how many segments it has there."""
        if unit.texts:
            at = self.runs()[0]
            h, text = self.anchor[at], self.text[at] if len(at) else at
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else at
            return h[new], text[new], np.diff(np.append(new, len(h)))
        # a place is an anchor if its seed is the least of some window around it
        reach = unit.window - unit.seed + 1
        least = np.concatenate([np.zeros(reach - 1, np.uint64), np.where(self.ok, self.anchor, np.uint64(0)), np.zeros(reach - 1, np.uint64)])
        most = ~rolling.sliding_min(~least, reach)
        at = np.flatnonzero((most == self.seeds) & (most > 0)) if len(self.anchor) else np.zeros(0, np.int64)
        return self.seeds[at], np.searchsorted(self.first, at, "right") - 1, np.ones(len(at), np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and the window after the last of each run in one text with one anchor."""
        n = len(self.anchor)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(n + 1, bool)
        new[1:n] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1]) | (self.ok[1:] != self.ok[:-1])
        bound = np.flatnonzero(new)
        own = self.ok[bound[:-1]]
        return bound[:-1][own], bound[1:][own]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def plain(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text alone, a null text as an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, hash and number of segments (n) of the anchors of plain(docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                h, text, n = Windows(part.column(1), unit).anchors(unit)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), _signed(h), pa.array(n, pa.int64())], names=["doc_id", "h", "n"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, h long, n long")


def dealt(size, limit: int):
    """The shard of a row by its doc_id: -1 for a group whose size is up to `limit`."""
    shards = F.ceil(size / limit).cast("long")
    return F.when(shards > 1, F.pmod(F.xxhash64("doc_id"), shards)).otherwise(F.lit(-1)).cast("int")


def segments(docs: DataFrame, unit: Unit, limit: int) -> DataFrame:
    """h, salt (-1 unless the anchor is dealt over shards), doc_id, fp, at (first unit) and body of each run of windows under a recurring anchor.

    `docs` is plain(docs) with fp, a fingerprint that tells rows of one doc_id apart.
    """
    found = anchors(docs.select("doc_id", "text"), unit)
    # counted and written: the join with the anchors can then split a frequent one over tasks
    recurring = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("size")).where("count > 1").drop("count"), "recurring")
    hits = found.join(recurring, "h").select("doc_id", F.struct("h", dealt(F.col("size"), limit).alias("salt")).alias("hit"))
    hits = hits.groupBy("doc_id").agg(F.collect_set("hit").alias("hits"))
    # rows without hits are left out in the tasks: a filter here would give the texts a shuffle of their own
    both = docs.select("doc_id", "text").join(hits.hint("shuffle_hash"), "doc_id", "left")
    both = both.select("doc_id", "text", fingerprint().alias("fp"), F.col("hits.h").alias("h"), F.col("hits.salt").alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.filter(pc.is_valid(batch.column(3)))):
                w = Windows(part.column(1), unit)
                lo, hi = w.runs()
                text, h = w.text[lo] if len(lo) else lo, w.anchor[lo] if len(lo) else lo.astype(np.uint64)
                hit, shard = part.column(3), part.column(4)
                n = np.diff(hit.offsets.to_numpy())
                known = hit.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                salts = shard.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(n)), n)
                # looks (text, h) up among the hits
                order = np.lexsort((known, of))
                key = rolling.mix(known[order] ^ (of[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                by = np.argsort(key)
                want = rolling.mix(h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                at = np.minimum(np.searchsorted(key[by], want), max(0, len(key) - 1))
                own = np.flatnonzero(key[by][at] == want) if len(key) and len(want) else np.zeros(0, np.int64)
                if not len(own):
                    continue
                lo, hi, text, h = lo[own], hi[own], text[own], h[own]
                salt = salts[order][by][at[own]]
                if unit.words:
                    data = w.raw.tobytes()
                    ends = hi + unit.window - 2
                    body = [b" ".join(data[a:b].split()) for a, b in zip(w.start[lo].tolist(), w.end[ends].tolist())]
                else:
                    data = w.raw.tobytes()
                    body = [data[a:b] for a, b in zip(lo.tolist(), (hi + unit.window - 1).tolist())]
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [_signed(h), pa.array(salt, pa.int32()), part.column(0).take(rows), part.column(2).take(rows), pa.array(lo - w.first[text], pa.int64()), pa.array(body, pa.binary())],
                    names=["h", "salt", "doc_id", "fp", "at", "body"],
                )

    return both.mapInArrow(run, "h long, salt int, doc_id long, fp int, at long, body binary").repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id")


def fingerprint():
    return F.hash("text")


def groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches of segments, cut anew so that each holds whole (h, salt) groups, at least `rows` rows if there are so many."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks()
        h, salt = whole.column("h").to_numpy(), whole.column("salt").to_numpy()
        change = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
        if not len(change):
            continue
        lo = 0
        for cut in [*change[np.searchsorted(change, np.arange(rows, int(change[-1]), rows))].tolist(), int(change[-1])]:
            if cut > lo:
                yield from whole.slice(lo, cut - lo).combine_chunks().to_batches()
                lo = cut
        kept = whole.slice(lo).to_batches()
        n = sum(b.num_rows for b in kept)
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


RANGES = "doc_id long, fp int, start long, end long"


def apply_ranges(docs: DataFrame, ranges: DataFrame, names: list[str], schema: str, work) -> DataFrame:
    """work(text, merged ranges of units) for every row of plain(docs); ranges come by doc_id and fp."""
    joined = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "start", "end")).alias("ranges"))
    both = docs.select("doc_id", "text").join(joined.hint("shuffle_hash"), "doc_id", "left")
    both = both.select("doc_id", "text", F.filter("ranges", lambda r: r["fp"] == fingerprint()).alias("r"))
    both = both.select("doc_id", "text", F.coalesce(F.col("r.start"), F.array()).alias("start"), F.coalesce(F.col("r.end"), F.array()).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                cut = [merged(a, b) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                rows = [work(t, c) for t, c in zip(part.column(1).cast(pa.binary()).to_pylist(), cut)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows))], names=names)

    return both.mapInArrow(run, schema)


def merged(start: list[int], end: list[int]) -> list[tuple[int, int]]:
    """Ranges joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start, end)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
