"""Compression of vectors into codes by Lloyd's rounds on heaps of bounds, exact in integers.

Vectors lie in blocks of a few thousand; a block is one row and is worked on by one task at a time. For
each part position and codebook entry a block keeps a heap of its parts, keyed by lower less upper
bound: how much nearer the part's own entry is than the next one, plus the drift of the entries up to then.
When entries have moved, only parts at the top of a heap whose key does not exceed the drift so far
can have another nearest entry; they are popped, compared with all entries exactly and pushed again.
Parts that change hands give differences of sums and counts, so a round shuffles as many numbers as the
codebooks hold for each task. Blocks with their heaps are written after each round and the round before is
deleted; a lost executor repeats its part of one round.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are
vectors whose length is not that of the vector of least id or no multiple of the parts. Rows of equal
ids stay each for itself; among the first, they are ordered by their components. Null ids come last.
With fewer vectors than entries there are as many entries as vectors. Components from 2^62 / 4096 on are
an error. No kept row gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block; a place in it takes PLACE bits of a heap's number, the key the rest.
BLOCK, PLACE = 8192, 13
#: Bounds are counted in 1/256, rounded to the safe side.
UNIT = 256
NEVER = 1 << 44
EXACT_DOUBLE, EXACT_LONG = 2.0**53, 2.0**62


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer components of the usable vectors of a batch, for each length that occurs."""
    col = batch.column(batch.schema.get_field_index("_vector"))
    lens = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
    flat = np.asarray(pc.fill_null(col.flatten(), float("nan")), np.float64)
    starts = np.cumsum(lens) - lens
    for dim in np.unique(lens):
        if not dim or dim % PARTS:
            continue
        rows = np.flatnonzero(lens == dim)
        v = flat[starts[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(v).all(1)
        scaled = np.floor(v[fine] * SCALE)
        if scaled.size and not np.abs(scaled).max() < EXACT_LONG:
            raise ValueError(f"a component of {np.abs(v[fine]).max()} is beyond {EXACT_LONG / SCALE}")
        yield rows[fine], scaled.astype(np.int64)


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """The components in the narrowest of 2, 4 and 8 bytes."""
    most = int(np.abs(x).max()) if x.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return x.astype(f"<i{width}").tobytes(), width


def _least(ids: pa.Array, x: np.ndarray) -> list[dict]:
    """The ENTRIES rows of least id; rows of equal ids by components."""
    order = pc.sort_indices(ids, null_placement="at_end")
    cut = ids[order[min(ENTRIES, len(ids)) - 1].as_py()]
    if cut.is_valid:
        rows = np.flatnonzero(np.asarray(pc.fill_null(pc.less_equal(ids, cut), False)))
    else:
        rows = np.arange(len(ids))
    keyed = sorted((((v := ids[int(i)].as_py()) is None, v, x[i].tolist()) for i in rows), key=lambda k: (k[0], 0 if k[0] else k[1], k[2]))
    return [{"none": n, "id": v, "v": c} for n, v, c in keyed[:ENTRIES]]


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}

    def out(dim: int) -> Iterator[pa.RecordBatch]:
        own = waiting.pop(dim)
        ids, labels, x = pa.concat_arrays([a for a, _, _ in own]), pa.concat_arrays([b for _, b, _ in own]), np.concatenate([c for _, _, c in own])
        for k in range(0, len(x), BLOCK):
            i, lab, part = ids[k : k + BLOCK], labels[k : k + BLOCK], x[k : k + BLOCK]
            data, width = _packed(part)
            first = pa.array([_least(i, part)], pa.list_(pa.struct([("none", pa.bool_()), ("id", i.type), ("v", pa.list_(pa.int64()))])))
            yield pa.RecordBatch.from_arrays([_list_of(i), _list_of(lab), pa.array([dim], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary()), first], names=["ids", "labels", "dim", "width", "vectors", "first"])

    for batch in batches:
        for rows, x in _matrices(batch):
            if len(rows):
                at = pa.array(rows)
                own = waiting.setdefault(x.shape[1], [])
                own.append((batch.column(0).take(at), batch.column(1).take(at), x))
                if sum(len(c) for _, _, c in own) >= BLOCK:
                    yield from out(x.shape[1])
    for dim in list(waiting):
        yield from out(dim)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: in doubles or longs while they hold them, else in Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    bound = 4.0 * most * most * x.shape[1]
    if bound < EXACT_DOUBLE:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    kind = np.int64 if bound < EXACT_LONG else object
    gap = x.astype(kind)[:, None, :] - book.astype(kind)[None, :, :]
    return (gap * gap).sum(2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (of equally near ones the first), and its slack in UNITs: how much farther the next one is, rounded down."""
    d = distances(x, book)
    own = np.argmin(d, 1)
    if book.shape[0] == 1:
        return own, np.full(len(x), NEVER)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own].astype(np.float64))
    # of two equal ones argmin leaves the second, whose slack is 0
    rest = d.astype(np.float64)
    rest[rows, own] = np.inf
    lower = np.sqrt(rest.min(1))
    slack = np.floor(((lower - upper) - (lower + upper) * 1e-12) * UNIT) - 1
    return own, np.clip(slack, -2, NEVER).astype(np.int64)


class Block:
    """The heaps of one block: lists of key << PLACE | place, by part position and entry."""

    def __init__(self, x: np.ndarray, books: np.ndarray, data: bytes | None, sizes: list[int] | None):
        self.x, self.books = x, books
        parts, entries, _ = books.shape
        self.heaps: list[list[list[int]]] | None = None
        if data is not None:
            numbers, ends = np.frombuffer(data, "<i8"), np.cumsum(sizes)
            lists = [own.tolist() for own in np.split(numbers, ends[:-1])]
            self.heaps = [lists[p * entries : (p + 1) * entries] for p in range(parts)]

    def step(self, drift: np.ndarray) -> np.ndarray:
        """Brings all parts to their nearest entries; returns changes of count and sums by part position and entry."""
        parts, entries, d = self.books.shape
        change = np.zeros((parts, entries, 1 + d), np.int64)
        new = [[[] for _ in range(entries)] for _ in range(parts)] if self.heaps is None else self.heaps
        for p in range(parts):
            x, heaps = self.x[:, p, :], new[p]
            if self.heaps is None:
                own, slack = nearest(x, self.books[p])
                numbers = ((slack + drift[p][own]) << PLACE) | np.arange(len(x))
                for j in range(entries):
                    mine = own == j
                    # a sorted list is a heap
                    heaps[j].extend(np.sort(numbers[mine]).tolist())
                    change[p, j, 0] += int(mine.sum())
                    change[p, j, 1:] += x[mine].sum(0)
                continue
            places, before = [], []
            for j, heap in enumerate(heaps):
                limit = int(drift[p, j])
                while heap and heap[0] >> PLACE <= limit:
                    places.append(heappop(heap) & (BLOCK - 1))
                    before.append(j)
            if not places:
                continue
            at, was = np.array(places), np.array(before)
            own, slack = nearest(x[at], self.books[p])
            for j, number in zip(own.tolist(), (((slack + drift[p][own]) << PLACE) | at).tolist()):
                heappush(heaps[j], number)
            moved = own != was
            for sign, entry in ((-1, was[moved]), (1, own[moved])):
                for j in np.unique(entry):
                    mine = x[at[moved][entry == j]]
                    change[p, j, 0] += sign * len(mine)
                    change[p, j, 1:] += sign * mine.sum(0)
        self.heaps = new
        return change

    def state(self) -> tuple[bytes, list[int]]:
        lists = [h for own in self.heaps for h in own]
        return np.fromiter((v for h in lists for v in h), np.int64, sum(map(len, lists))).tobytes(), [len(h) for h in lists]

    def codes(self) -> np.ndarray:
        out = np.zeros(self.x.shape[:2], np.uint8)
        for p, heaps in enumerate(self.heaps):
            for j, heap in enumerate(heaps):
                out[np.array(heap, np.int64) & (BLOCK - 1), p] = j
        return out

    def errors(self, codes: np.ndarray) -> list[int]:
        total = np.zeros(len(self.x), object)
        for p in range(self.x.shape[1]):
            x, book = self.x[:, p, :], self.books[p][codes[:, p]]
            bound = 4.0 * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 * x.shape[1]
            gap = x.astype(np.int64 if bound < EXACT_LONG else object) - book
            total = total + (gap * gap).sum(1).astype(object)
        return total.tolist()


def _opened(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Block]]:
    parts, _, d = books.shape
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        get = lambda name: row.column(row.schema.get_field_index(name))[0].as_py()  # noqa: E731, B023
        x = np.frombuffer(get("vectors"), f"<i{get('width')}").reshape(-1, parts, d).astype(np.int64)
        yield row, Block(x, books, get("heaps"), get("sizes"))


def _round(table: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _opened(batch, books):
                change = block.step(drift)
                data, sizes = block.state()
                kept = [row.column(row.schema.get_field_index(n)) for n in ("ids", "labels", "width", "vectors")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([data], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([change.ravel()], pa.list_(pa.int64()))], names=["ids", "labels", "width", "vectors", "heaps", "sizes", "change"])

    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return table.mapInArrow(run, f"ids {types['ids']}, labels {types['labels']}, width int, vectors binary, heaps binary, sizes array<int>, change array<bigint>")


def _last(table: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _opened(batch, books):
                block.step(drift)
                codes = block.codes()
                flat, width = codes.tobytes().hex(), 2 * codes.shape[1]
                text = [flat[k : k + width] for k in range(0, len(flat), width)]
                ids, labels = (row.column(row.schema.get_field_index(n)).flatten() for n in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(block.errors(codes), pa.int64())], names=["vec_id", "label", "code", "error"])

    of = {f.name: f.dataType.elementType.simpleString() for f in table.schema.fields if f.name in ("ids", "labels")}
    return table.mapInArrow(run, f"vec_id {of['ids']}, label {of['labels']}, code string, error bigint")


def _fixed(moved: list[list[int]]) -> list[int]:
    """Lengths of the moves of a codebook's entries in UNITs, rounded up."""
    out = []
    for gap in moved:
        square = sum(g * g for g in gap)
        out.append(0 if not square else (math.isqrt(square * UNIT * UNIT) + 2))
    return out


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code and error of every usable vector, and the final codebooks: by part position, entry, place.

    The driver holds the codebooks alone: ENTRIES times the length of a vector.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_vector"))
    key_type, label_type = (f.dataType.simpleString() for f in own.schema.fields[:2])
    made = own.mapInArrow(_blocks, f"ids array<{key_type}>, labels array<{label_type}>, dim int, width int, vectors binary, first array<struct<none: boolean, id: {key_type}, v: array<bigint>>>")
    table, discard = stored(made, "vector-blocks")
    first = table.select("dim", F.explode("first").alias("f")).orderBy("f.none", "f.id", "dim", "f.v")
    found = first.limit(1).collect()
    if not found:
        discard()
        empty = T.StructType([T.StructField("vec_id", own.schema[0].dataType), T.StructField("label", own.schema[1].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return spark.createDataFrame([], empty), []
    dim = found[0]["dim"]
    rows = first.where(F.col("dim") == dim).limit(ENTRIES).collect()
    d = dim // PARTS
    books = [[r["f"]["v"][p * d : (p + 1) * d] for r in rows] for p in range(PARTS)]
    entries = len(rows)
    table = table.where(F.col("dim") == dim).select("ids", "labels", "width", "vectors", F.lit(None).cast("binary").alias("heaps"), F.lit(None).cast("array<int>").alias("sizes"))
    drift = [[0] * entries for _ in range(PARTS)]
    totals = [0] * (PARTS * entries * (1 + d))
    for _ in range(rounds):
        table, after = stored(_round(table, np.array(books, np.int64), np.array(drift, np.int64)), "vector-blocks")
        discard()
        discard = after
        sums = table.select(F.posexplode("change").alias("at", "v")).where("v <> 0").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
        for r in sums.collect():
            totals[r["at"]] += int(r["s"])
        for p in range(PARTS):
            moved = []
            for j in range(entries):
                at = (p * entries + j) * (1 + d)
                n = totals[at]
                mean = [s // n for s in totals[at + 1 : at + 1 + d]] if n else books[p][j]
                moved.append([a - b for a, b in zip(mean, books[p][j])])
                books[p][j] = mean
            step = _fixed(moved)
            for j in range(entries):
                others = step[:j] + step[j + 1 :]
                drift[p][j] = min(NEVER * 2, drift[p][j] + step[j] + max(others, default=0))
    coded, _ = stored(_last(table, np.array(books, np.int64), np.array(drift, np.int64)), "vector-codes")
    discard()
    return coded, books


def digest(coded: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of an equal label, nulls together) and codebooks_sha256."""
    sha = hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()
    # written, so that Spark knows its size when it chooses the join
    sums, _ = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
