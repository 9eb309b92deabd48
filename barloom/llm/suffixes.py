"""Substring dedup by suffix arrays, built in two stages.

Segments under recurring anchors (seeds.py) come together by anchor. The distinct segments of a shard
that still need comparing are one text with separators. Suffixes smaller than their successors are
sorted directly; the rest are induced from them by a scan over the buckets of first characters; then
the common prefixes of neighbours are computed. Only the first `window` bytes count, so both the
order and the prefixes stop there. A window that is as long as its common prefix with a neighbour
starts elsewhere too.

A frequent anchor is dealt over shards by document. What its shards have in common is found by further
keys: the windows of each shard's distinct segments meet again by three more of their seeds, where the
surroundings of a common passage tell them apart. Only where such a key is frequent too do single windows
meet by their hash.

Nulls: a null text has no bytes; a row with a null doc_id is kept whole and counts nowhere. Rows of
equal doc_id count as different places. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .seeds import RANGES, Unit, apply_ranges, dealt, groups, plain, segments
from .workspace import written

#: Segments that are looked at together, and bytes of distinct ones under one suffix array (a larger group goes by itself).
SHARD_ROWS = 8_000
SHARD_BYTES = 1 << 19
_PENDING = "h long, w long, doc_id long, fp int, start long, repeats boolean"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of an array of small integers, in the order of their first `depth` items.

    Suffixes smaller than their successors are sorted directly; the others follow from the order of
    their successors: buckets are scanned upwards, and the predecessor of each suffix found is put
    next into the bucket of its first item.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # a suffix is larger than its successor if the next different item is smaller; the last one is larger
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    nxt = change[np.searchsorted(change, np.arange(n))]
    after = np.append(text, 0)[nxt + 1]
    larger = np.where(nxt == n - 1, True, after < text)
    data = text.astype(np.uint8).tobytes()
    small_arr = np.flatnonzero(~larger)
    small_arr = small_arr[np.argsort(text[small_arr], kind="stable")]
    cut = np.searchsorted(text[small_arr], np.arange(258))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):  # bucket by bucket, which keeps few keys at a time
        if hi - lo > 1:
            small_arr[lo:hi] = sorted(small_arr[lo:hi].tolist(), key=lambda i: data[i : i + depth])
    small_first = text[small_arr] if len(small_arr) else small_arr
    bounds = np.searchsorted(small_first, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # the end of the text is the least of all successors
    out = []
    for c in range(257):
        own = []
        front = np.concatenate(waiting[c]) if waiting[c] else None
        while front is not None and len(front):  # within the bucket: predecessors with the same first item
            own.append(front)
            before = front[front > 0] - 1
            front = before[(text[before] == c) & larger[before]]
        own.append(small_arr[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(own)
        if len(whole):
            out.append(whole)
            before = whole[whole > 0] - 1
            before = before[larger[before] & (text[before] > c)]
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
            for lo, hi in zip(cut, [*cut[1:], len(first)]):
                waiting[first[lo]].append(before[lo:hi])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` with the next one, `depth` at most; 0 for the last.

    Found by halving, on hashes of segments; a prefix of full depth is also compared byte by byte.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[:-1], order[1:]
    hashes = rolling.Segments(text)
    most = np.minimum(depth, len(text) - np.maximum(a, b))
    whole = hashes.of(a, a + most) == hashes.of(b, b + most)
    out[:-1][whole] = most[whole]
    rest = np.flatnonzero(~whole)
    low, high = np.zeros(len(rest), np.int64), most[rest]  # equal up to low, not up to high
    while len(rest) and (high - low).max() > 1:
        mid = (low + high) >> 1
        same = hashes.of(a[rest], a[rest] + mid) == hashes.of(b[rest], b[rest] + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid)
    out[rest] = low
    data = text.astype(np.uint8).tobytes()
    for i in np.flatnonzero(whole & (most == depth)).tolist():
        x, y = int(a[i]), int(b[i])
        if data[x : x + depth] != data[y : y + depth]:
            out[i] = depth - 1
    return out


def repeating(bodies: list[bytes], window: int) -> list[np.ndarray]:
    """Starts of the windows of each of some distinct byte strings that start elsewhere in them as well."""
    lens = np.fromiter(map(len, bodies), np.int64, len(bodies))
    raw = np.frombuffer(b"\0".join(bodies), np.uint8)
    starts = np.cumsum(lens + 1) - lens - 1
    last = np.repeat(starts + lens - window, lens + 1)[: len(raw)]  # the last window of each place's string
    # separators must not match: windows that reach one are left out below, so their order is no matter
    order = suffix_array(raw.astype(np.int16), window)
    prefix = common_prefixes(raw, order, window)
    # windows that run over the end of their string are taken out, then neighbours are compared anew
    real = order <= last[order]
    kept = order[real]
    run = np.cumsum(prefix < window)  # a new class begins after each shorter prefix
    cls = np.append(0, run[:-1])[real]
    same = cls[1:] == cls[:-1]
    hit = np.zeros(len(kept), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at = np.sort(kept[hit])
    of = np.searchsorted(starts, at, "right") - 1
    cut = np.searchsorted(of, np.arange(len(bodies) + 1))
    return [at[cut[i] : cut[i + 1]] - starts[i] for i in range(len(bodies))]


class Shard:
    """Groups of segments: which windows of each distinct segment repeat within its group."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window = window
        self.group = list(zip(batch.column("h").to_pylist(), batch.column("salt").to_pylist()))
        self.doc, self.fp, self.at = (batch.column(c).to_pylist() for c in ("doc_id", "fp", "at"))
        self.body = batch.column("body").to_pylist()
        count: dict[tuple, dict[bytes, int]] = {}
        for g, b in zip(self.group, self.body):
            own = count.setdefault(g, {})
            own[b] = own.get(b, 0) + 1
        #: For each group and distinct segment: None if all windows repeat, else the starts of those that do.
        self.hits: dict[tuple, dict[bytes, np.ndarray | None]] = {}
        todo: list[tuple[tuple, list[bytes]]] = []
        for g, own in count.items():
            # copies of a segment repeat one another; each distinct one goes into the array once
            self.hits[g] = {b: None for b, n in own.items() if n > 1}
            if len(own) > 1 or not self.hits[g]:  # one segment that stands alone may repeat itself
                todo.append((g, list(own)))
        part: list[tuple[tuple, bytes]] = []
        size = 0
        for g, own in todo:
            if part and size + sum(map(len, own)) > SHARD_BYTES:
                self._array(part)
                part, size = [], 0
            part += [(g, b) for b in own]
            size += sum(map(len, own))
        self._array(part)

    def _array(self, part: list[tuple[tuple, bytes]]) -> None:
        """Repeats within the groups of `part`, by a suffix array of what may repeat.

        A window whose hash is single in its group can't repeat there: segments are trimmed to the rest.
        """
        if not part:
            return
        lens = np.fromiter((len(b) for _, b in part), np.int64, len(part))
        start = np.cumsum(lens) - lens
        names = {g: i for i, g in enumerate(dict.fromkeys(g for g, _ in part))}
        group = np.repeat(np.array([names[g] for g, _ in part]), lens)
        hashes = rolling.Segments(np.frombuffer(b"".join([b for _, b in part]), np.uint8)).windows(self.window)
        of = np.repeat(np.arange(len(part)), lens)[: len(hashes)]
        inside = np.flatnonzero(np.arange(len(hashes)) + self.window <= (start + lens)[of])
        keys = rolling.mix(hashes[inside] + group[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        may = inside[count[where] > 1]
        first = np.searchsorted(may, start)
        last = np.searchsorted(may, start + lens)
        left = np.flatnonzero(last > first)
        low = may[first[left]] - start[left] if len(left) else left
        high = may[last[left] - 1] - start[left] + self.window if len(left) else left
        for g, b in part:
            self.hits[g].setdefault(b, np.zeros(0, np.int64))
        if not len(left):
            return
        bodies = [part[i][1][x:y] for i, x, y in zip(left.tolist(), low.tolist(), high.tolist())]
        for i, x, hit in zip(left.tolist(), low.tolist(), repeating(bodies, self.window)):
            g, b = part[i]
            if (own := self.hits[g][b]) is not None:
                self.hits[g][b] = np.union1d(own, hit + x).astype(np.int64)

    def repeats(self, g: tuple, b: bytes) -> np.ndarray:
        n = len(b) - self.window + 1
        out = np.zeros(n, bool)
        hit = self.hits[g].get(b, ())
        out[slice(None) if hit is None else np.asarray(hit, np.int64)] = True
        return out


def _inside(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches, SHARD_ROWS):
        shard = Shard(batch, window)
        out: tuple[list, list, list, list] = ([], [], [], [])
        spans: dict[tuple, list[tuple[int, int]]] = {}
        for g, d, fp, at, b in zip(shard.group, shard.doc, shard.fp, shard.at, shard.body):
            if (own := spans.get((g, b))) is None:
                hit = np.concatenate([[False], shard.repeats(g, b), [False]]).astype(np.int8)
                edge = np.diff(hit)
                own = spans[g, b] = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + window).tolist()))
            for lo, hi in own:
                for x, v in zip(out, (d, fp, at + lo, at + hi)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "fp", "start", "end"])


def _pending(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of anchors that are dealt over shards: one row for each distinct window of a shard."""
    for batch in groups((b.filter(pc.greater_equal(b.column("salt"), 0)) for b in batches), SHARD_ROWS):
        shard = Shard(batch, window)
        seen: set[tuple] = set()
        for g, d, fp, at, b in zip(shard.group, shard.doc, shard.fp, shard.at, shard.body):
            if (g, b) in seen:
                continue
            seen.add((g, b))
            repeats = shard.repeats(g, b)
            w = rolling.Segments(np.frombuffer(b, np.uint8)).windows(window).view(np.int64)
            _, one = np.unique(w, return_index=True)
            n = len(one)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, g[0])), pa.array(w[one]), pa.array([d] * n, pa.int64()), pa.array([fp] * n, pa.int32()), pa.array(at + one), pa.array(repeats[one])],
                names=["h", "w", "doc_id", "fp", "start", "repeats"],
            )


#: Salts of the further seeds by which a frequent anchor's windows are told apart.
_FURTHER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def further_keys(body: bytes, window: int, seed: int) -> np.ndarray:
    """A key of each window: the seeds in it that are least by three other hashes. Equal windows have equal keys."""
    seeds = rolling.Segments(np.frombuffer(body, np.uint8)).windows(seed)
    keys = np.zeros(len(body) - window + 1, np.uint64)
    for salt in _FURTHER:
        keys = rolling.mix(keys + rolling.sliding_min(rolling.mix(seeds ^ salt), window - seed + 1))
    return keys


def _parts(batches: Iterator[pa.RecordBatch], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of anchors that are dealt over shards: each shard's distinct segments, cut where the windows' further keys change.

    Copies of a segment in its shard repeat one another, which the shard itself has found; one of them speaks for all.
    """
    for batch in groups((b.filter(pc.greater_equal(b.column("salt"), 0)) for b in batches), SHARD_ROWS):
        seen: set[tuple] = set()
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for h, salt, d, fp, at, b in zip(*(batch.column(c).to_pylist() for c in ("h", "salt", "doc_id", "fp", "at", "body"))):
            if (h, salt, b) in seen:
                continue
            seen.add((h, salt, b))
            keys = further_keys(b, window, seed)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            own = rolling.mix(keys[first] + np.array([h], np.int64).view(np.uint64)).view(np.int64)
            for k, lo, hi in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
                for x, v in zip(out, (k, d, fp, at + lo, b[lo : hi + window - 1])):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["h", "doc_id", "fp", "at", "body"])


def repeated_ranges(docs: DataFrame, window: int = 400, seed: int = 32, limit: int = 4000) -> DataFrame:
    """doc_id, fp, start, end: ranges of bytes in windows that start anywhere else as well; ranges may overlap."""
    unit = Unit(words=False, window=window, seed=seed, texts=False)
    found = segments(docs, unit, limit)
    inside = found.mapInArrow(lambda b: _inside(b, window), RANGES)
    # what shards of one anchor have in common: segments by further keys, then, where such a key is frequent as well, single windows
    parts = written(found.mapInArrow(lambda b: _parts(b, window, seed), "h long, doc_id long, fp int, at long, body binary"), "parts")
    sizes = parts.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = parts.join(sizes, "h").select("h", dealt(F.col("size"), limit).alias("salt"), "doc_id", "fp", "at", "body")
    parts = parts.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id")
    between = parts.mapInArrow(lambda b: _inside(b, window), RANGES)
    pending = parts.mapInArrow(lambda b: _pending(b, window), _PENDING)
    several = pending.groupBy("h", "w").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    across = pending.where(~F.col("repeats")).join(several, ["h", "w"]).select("doc_id", "fp", "start", (F.col("start") + window).alias("end"))
    return inside.unionByName(between).unionByName(across)


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    kept, at, removed = [], 0, 0
    for a, b in ranges:
        kept.append(text[at:a])
        removed += b - a
        at = b
    kept.append(text[at:])
    return len(text), removed, len(ranges), b"".join(kept)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 400, seed: int = 32, limit: int = 4000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row."""
    own = plain(docs, text)
    return apply_ranges(own, repeated_ranges(own, window, seed, limit), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", _cut)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
