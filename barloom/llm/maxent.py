"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token is a lower-cased word or a text's end. The most frequent words make classes of `MEMBERS`
words; all others fall into tail classes by their last bytes. The probability of a token is that of
its class given the context, by a softmax over classes, times that of the word given its class: for
frequent words a softmax over the class's members given the context, for a tail word its smoothed
share of the class. Contexts are features hashed into rows of weights: the word before, the one
before that (a skip), both together, and the word three back with the one before.

The counts come from all training texts and start the biases. Then every training text is used once,
in `rounds` rounds: tasks take gradient steps on their texts from the present weights, and the
changes of each row of weights, averaged over the tasks that touched it, make the next weights. The
model has a fixed size whatever the corpus. Texts are scored in blocks, in sparse numpy batches; the
counts of rarer words are joined with the blocks that hold them.

Nulls: a null text is empty and has one token, its end; a null id counts as training. Repeated rows
are scored alike. An empty training set scores by the smoothing alone. Of equally frequent words the
one of lesser hash is taken as the more frequent. Counts and base scores are exact; the model's scores
vary a little with the partitions of the input, over which training is averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .columnar import text_bytes, text_slices
from .workspace import small_batches, written

HEADS, MEMBERS, TAILS = 32, 32, 32
CLASSES = HEADS + TAILS
#: log2 of the rows of weights for classes, and for members.
CLASS_BITS, MEMBER_BITS = 14, 15
FEATURES = 4
#: Tokens of a gradient step and of a scoring batch.
BATCH = 8192
#: Words whose counts go along with the tasks; the counts of all others are joined.
CARRIED = 30_000
#: Tokens of a block of texts that is scored together.
BLOCK = 1_000_000
_END = np.uint64(0x5DEECE66D1234567)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Tokens:
    """Hash, tail class and text of every token of a batch of texts, an end after each text's words."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_bytes(texts)
        raw = rolling.lower(raw)
        start, end, first = rolling.words(raw, offsets)
        n, k = len(start), len(texts)
        self.count = np.diff(first) + 1
        self.text = np.repeat(np.arange(k), self.count)
        self.ends = np.cumsum(self.count) - 1
        at = np.arange(n) + np.repeat(np.arange(k), np.diff(first))
        self.hash = np.full(n + k, _END, np.uint64)
        self.tail = np.zeros(n + k, np.int64)
        if n:
            self.hash[at] = rolling.word_hashes(raw, start, end)
            last, before = raw[end - 1].astype(np.int64), np.where(end - start > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.int64)
            third = np.where(end - start > 2, raw[np.maximum(end - 3, 0)], 0).astype(np.int64)
            self.tail[at] = ((last * 31 + before) * 17 + third) * 0x9E3779B1 % (1 << 32) >> 27
        self.place = np.arange(n + k) - np.repeat(self.ends - self.count + 1, self.count)

    def features(self) -> np.ndarray:
        """A row of FEATURES hashes for each token."""
        h = self.hash
        back = []
        for d in (1, 2, 3):
            b = np.full(len(h), np.uint64(d), np.uint64)
            b[d:] = np.where(self.place[d:] >= d, h[:-d], np.uint64(d)) if len(h) > d else b[d:]
            back.append(b)
        one, two, three = back
        return np.stack([rolling.mix(one ^ _SALTS[0]), rolling.mix(two ^ _SALTS[1]), rolling.mix(rolling.mix(one) + two ^ _SALTS[2]), rolling.mix(rolling.mix(one) + three ^ _SALTS[3])], 1)


@dataclass
class Model:
    """Frequent words, smoothed tails, and the weights."""

    words: np.ndarray  # sorted hashes of the frequent words
    place: np.ndarray  # class * MEMBERS + member of each
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_rows: np.ndarray
    member_rows: np.ndarray

    def locate(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each token; member -1 in a tail."""
        if not len(self.words):
            return HEADS + t.tail, np.full(len(t.hash), -1)
        at = np.minimum(np.searchsorted(self.words, t.hash), len(self.words) - 1)
        known = self.words[at] == t.hash
        place = np.where(known, self.place[at], -1)
        return np.where(known, place // MEMBERS, HEADS + t.tail), np.where(known, place % MEMBERS, -1)

    def rows(self, features: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of class weights and of member weights of each token's features."""
        own = (features >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        salted = rolling.mix(features + cls[:, None].astype(np.uint64) * _SALTS[0])
        return own, (salted >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)

    def log_probability(self, t: Tokens, count: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability, given its count in the training texts."""
        cls, member = self.locate(t)
        out = np.empty(len(cls))
        features = t.features()
        for lo in range(0, len(cls), BATCH):
            s = slice(lo, lo + BATCH)
            own, inner = self.rows(features[s], cls[s])
            z = _gather(self.class_rows, own)
            z += self.class_bias
            out[s] = _log_softmax(z, cls[s])
            head = np.flatnonzero(member[s] >= 0)
            if len(head):
                z = _gather(self.member_rows, inner[head])
                z += self.member_bias[cls[s][head]]
                out[lo + head] += _log_softmax(z, member[s][head])
        tail = np.flatnonzero(member < 0)
        k = cls[tail] - HEADS
        out[tail] += np.log((count[tail] + 0.5) / (self.tail_tokens[k] + 0.5 * (self.tail_types[k] + 1)))
        return out


def _gather(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of all features of each token."""
    out = rows.take(at[:, 0], axis=0)
    more = np.empty_like(out)
    for j in range(1, at.shape[1]):
        out += rows.take(at[:, j], axis=0, out=more, mode="clip")
    return out


#: Logits are held below this, so that exponents and their sums stay finite.
TOP = np.float32(80)


def _exp_sums(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponents (in place) and their sums by row."""
    np.exp(np.minimum(z, TOP, out=z), out=z)
    return z, np.maximum(z @ np.ones(z.shape[1], z.dtype), np.float32(1e-37))


def _log_softmax(z: np.ndarray, pick: np.ndarray) -> np.ndarray:
    own = np.minimum(z[np.arange(len(z)), pick], TOP)
    return own - np.log(_exp_sums(z)[1])


def counts(texts: DataFrame) -> DataFrame:
    """h, tail and c: how often each token occurs in a table of texts."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, tail, c = map(np.concatenate, zip(*parts))
        h, first, where = np.unique(h, return_index=True, return_inverse=True)
        return h, tail[first], np.bincount(where, c, len(h)).astype(np.int64)

    def rows(h: np.ndarray, tail: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(c)], names=["h", "tail", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in text_slices(batch):
                t = Tokens(part.column(0))
                h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
                parts.append((h, t.tail[first], n))
                if sum(len(x[0]) for x in parts) > 1 << 20:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > 1 << 19:
                        yield rows(*parts.pop())
        if parts:
            yield rows(*merged(parts))

    return texts.mapInArrow(run, "h long, tail int, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def start(known: DataFrame) -> Model:
    """The model that the counts alone give."""
    top = known.orderBy(F.desc("c"), "h").limit(HEADS * MEMBERS).collect()
    head = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    c = np.array([r["c"] for r in top], np.float64)
    # members of a class have like counts; ranks run on from class to class
    place = np.arange(len(head))
    order = np.argsort(head)
    member = np.full(HEADS * MEMBERS, -30.0)
    member[: len(c)] = np.log(c)
    mass = np.zeros(CLASSES)
    np.add.at(mass, place // MEMBERS, c)
    tokens, types = np.zeros(TAILS), np.zeros(TAILS)
    for r in known.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["tail"]], types[r["tail"]] = r["n"], r["v"]
    for r, n in zip(top, c):
        tokens[r["tail"]] -= n
        types[r["tail"]] -= 1
    mass[HEADS:] = tokens + 0.5 * (types + 1)
    mass[:HEADS] += 1e-9
    return Model(
        head[order], place[order], tokens, types, np.log(mass / mass.sum()).astype(np.float32), member.reshape(HEADS, MEMBERS).astype(np.float32),
        np.zeros((1 << CLASS_BITS, CLASSES), np.float32), np.zeros((1 << MEMBER_BITS, MEMBERS), np.float32),
    )


def _step(rows: np.ndarray, squares: np.ndarray, seen: np.ndarray, at: np.ndarray, error: np.ndarray, rate: float) -> None:
    """An adaptive gradient step on the rows of all features; a row's gradients are summed first."""
    flat = at.ravel().astype(np.uint16)  # of 16 bits, which sort by radix
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    own = flat[first].astype(np.int64)
    grad = _run_sums(error, order // at.shape[1], first)
    squares[own] += np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
    seen[own] += np.diff(np.append(first, len(flat)))
    grad *= (np.float32(rate) / np.sqrt(squares[own] + np.float32(1)))[:, None]
    grad += rows.take(own, axis=0)
    rows[own] = grad


def _run_sums(rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows[at] over the runs that begin at `first`: most runs are short and are added place by place."""
    last = np.append(first[1:], len(at))
    n = last - first
    out = rows.take(at[first], axis=0)
    live, k = np.flatnonzero(n > 1), 1
    while len(live) and k < 8:
        more = rows.take(at[first[live] + k], axis=0)
        more += out.take(live, axis=0)
        out[live] = more
        k += 1
        live = live[n[live] > k]
    for i in live.tolist():
        out[i] += rows[at[first[i] + 8 : last[i]]].sum(axis=0)
    return out


def _learn(model: Model, t: Tokens, squares: tuple[np.ndarray, np.ndarray], seen: tuple[np.ndarray, np.ndarray], rate: float) -> None:
    cls, member = model.locate(t)
    features = t.features()
    for lo in range(0, len(cls), BATCH):
        s = slice(lo, lo + BATCH)
        own, inner = model.rows(features[s], cls[s])
        for rows, bias, at, pick, k in (
            (model.class_rows, model.class_bias, own, cls[s], 0),
            (model.member_rows, model.member_bias[np.minimum(cls[s], HEADS - 1)], inner, member[s], 1),
        ):
            if k:
                keep = np.flatnonzero(pick >= 0)
                at, pick, bias = at[keep], pick[keep], bias[keep]
            if not len(pick):
                continue
            z = _gather(rows, at)
            z += bias
            z, sums = _exp_sums(z)
            z *= (-1 / sums)[:, None]
            z[np.arange(len(z)), pick] += 1
            _step(rows, squares[k], seen[k], at, z, rate)


#: Rows of weights that travel together.
CHUNK = 512


def _updates(texts: DataFrame, model: Model, rate: float) -> DataFrame:
    """From each task, whose partition is its lane, the changed weights in chunks: for every row how often it was used, and the change times that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**{**model.__dict__, "class_rows": model.class_rows.copy(), "member_rows": model.member_rows.copy()})
        kinds = ((model.class_rows, own.class_rows), (model.member_rows, own.member_rows))
        squares = tuple(np.zeros(len(a), np.float32) for a, _ in kinds)
        seen = tuple(np.zeros(len(a), np.float32) for a, _ in kinds)
        for batch in batches:
            for part in text_slices(batch):
                _learn(own, Tokens(part.column(0)), squares, seen, rate)
        out, lane = [], TaskContext.get().partitionId()
        for k, (a, b) in enumerate(kinds):
            for lo in range(0, len(a), CHUNK):
                use = seen[k][lo : lo + CHUNK]
                if use.any():
                    change = ((b[lo : lo + CHUNK] - a[lo : lo + CHUNK]) * use[:, None]).astype(np.float32)
                    out.append((k * (1 << 20) + lo, lane, zlib.compress(use.tobytes() + _half(change, use), 1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["chunk", "lane", "sums"])

    return texts.mapInArrow(run, "chunk long, lane int, sums binary")


def _half(change: np.ndarray, use: np.ndarray) -> bytes:
    """The changes themselves at half precision; they are times the uses again when summed."""
    return (change / np.maximum(use, 1e-9)[:, None]).astype(np.float16).tobytes()


def _sum(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    use, change = None, None
    for raw in table.column("sums"):
        data = zlib.decompress(raw.as_py())
        u = np.frombuffer(data, np.float32, CHUNK)
        c = np.frombuffer(data, np.float16, offset=4 * CHUNK).reshape(CHUNK, -1).astype(np.float64) * u[:, None]
        use, change = (u.astype(np.float64), c) if use is None else (use + u, change + c)
    return use, change


def _mean(keys: tuple, table: pa.Table) -> pa.Table:
    use, change = _sum(table)
    body = use.astype(np.float32).tobytes() + (change / np.maximum(use, 1e-9)[:, None]).astype(np.float16).tobytes()
    return pa.table({"chunk": pa.array([keys[0].as_py()], pa.int64()), "lane": pa.array([keys[1].as_py()], pa.int32()), "sums": pa.array([zlib.compress(body, 1)], pa.binary())})


#: Tokens of all rounds that a training task has on average, at least: every task sends the rows that it changed.
TASK_TOKENS = 4_000_000
#: Tasks whose changes are summed in one group at most.
FAN = 32


def train(
    texts: DataFrame, model: Model, rounds: int = 3, rate: float = 0.35, part: Column | None = None, tokens: int | None = None, task_tokens: int = TASK_TOKENS, fan: int = FAN
) -> Model:
    """Uses every text of `texts` (one column, text) once: those of a round together, in as many tasks as `tokens` (all; their letters if not given) ask for at most.

    The changes of tasks are averaged, so weights vary a little with the way the rows are dealt over tasks. They are
    summed in levels, `fan` lanes at a time, so that no group grows with the number of tasks.
    """
    if tokens is None:
        tokens = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    tasks = max(1, -(-tokens // task_tokens))
    texts = texts.coalesce(tasks)
    part = F.pmod(F.xxhash64("text"), F.lit(rounds)) if part is None else part
    for k in range(rounds):
        found = _updates(texts.where(part == k), model, rate / (1 + k) ** 0.5)
        left = tasks
        while left > 1:
            found = found.withColumn("lane", F.floor(F.col("lane") / fan).cast("int")).groupBy("chunk", "lane").applyInArrow(_mean, "chunk long, lane int, sums binary")
            left = -(-left // fan)
        rows = [model.class_rows.copy(), model.member_rows.copy()]
        for r in found.collect():
            data = zlib.decompress(r["sums"])
            kind, lo = divmod(r["chunk"], 1 << 20)
            rows[kind][lo : lo + CHUNK] += np.frombuffer(data, np.float16, offset=4 * CHUNK).reshape(CHUNK, -1)
        model = Model(**{**model.__dict__, "class_rows": rows[0], "member_rows": rows[1]})
    return model


def score(docs: DataFrame, held_out: Column, text: str = "text", rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; the model learns from rows that are not held out."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    training = own.where("NOT held_out").select("text")
    known = written(counts(training), "counts")
    total = known.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    model = train(training, start(known), rounds, tokens=n)

    carried = known.orderBy(F.desc("c"), "h").limit(CARRIED).collect()
    h = np.array([r["h"] for r in carried], np.int64).view(np.uint64)
    order = np.argsort(h)
    h, c = h[order], np.array([r["c"] for r in carried], np.int64)[order]

    # texts come together in blocks; the counts of the other words of a block are joined with it
    blocks = max(1, -(-5 * n // (4 * BLOCK)))
    own = own.withColumn("block", F.pmod(F.xxhash64("text", "doc_id"), F.lit(blocks)).cast("int")).repartition("block")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each block that are not carried; rows come by block, which may go on from batch to batch."""
        of, found = None, []

        def rows() -> pa.RecordBatch:
            one = np.unique(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.full(len(one), of, np.int32))], names=["h", "block"])

        for batch in batches:
            for k in np.unique(batch.column(3).to_numpy()):
                if k != of and found:
                    yield rows()
                    found = []
                of = k
                for part in text_slices(batch.filter(pc.equal(batch.column(3), pa.scalar(k, pa.int32())))):
                    one = np.unique(Tokens(part.column(2)).hash)
                    found.append(one[_lookup(h, c, one) == 0])
        if found:
            yield rows()

    words = own.sortWithinPartitions("block").mapInArrow(rare, "h long, block int").join(known.select("h", "c"), "h").select("block", "h", "c")

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        more = words.column("h").to_numpy().view(np.uint64)
        more, first = np.unique(more, return_index=True)
        often = words.column("c").to_numpy()[first]
        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in text_slices(batch):
                t = Tokens(part.column(2))
                count = _lookup(h, c, t.hash)
                left = np.flatnonzero(count == 0)
                count[left] = _lookup(more, often, t.hash[left])
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                of = t.ends - t.count + 1
                value = np.add.reduceat(model.log_probability(t, count), of) / np.log(10)
                k = part.num_rows
                out.append(pa.table([part.column(0), part.column(1), pa.array(t.count), pa.array(np.add.reduceat((count > 0).astype(np.int64), of)), pa.array(np.full(k, n, np.int64)), pa.array(np.add.reduceat(base, of)), pa.array(value)], names=NAMES))
        return pa.concat_tables(out) if out else pa.table([texts.column(0).slice(0, 0), pa.array([], pa.bool_()), *[pa.array([], t) for t in TYPES]], names=NAMES)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, schema)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The values of sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(want), np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0)
