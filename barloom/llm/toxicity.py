"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

Two words are compared by the gap-weighted subsequences of three characters that they share: a
subsequence that spans s characters counts decay**s, up to a span of `SPAN`; a word's begin and end
count as a character. Inserted characters and gaps lower the similarity little; one below `FLOOR`
counts as none. A sentence is compared with a landmark word by its most similar word. Landmarks are
words that go with the label in a bounded sample of labelled rows, chosen one after the other: what the
chosen ones explain speaks less for the next. The Nyström map of their kernel matrix gives a linear
machine, trained on the sentences of that sample (of a toxic document only the worst sentence is taken
as toxic). A document's score is a logistic curve over three figures of the machine: the margin of its
worst sentence, the sum of its words' positive margins, and its number of words; so one likeness by
chance in a long text speaks less than several in a short one.

All words are compared: most need no more than a bound of their similarity, which is summed over all
characters of a slice at once. Nothing is remembered from slice to slice.

Nulls: a null or empty text scores as a text without words; a null doc_id is kept, and its row is not
learnt from. Repeated rows score alike. Of words with equal z-scores the lesser comes first, and of
sentences with equal margins all count. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import ragged, text_slices
from .workspace import small_batches, written

SPAN = 5
DECAY = 0.7
#: Places of a subsequence after its first character: (second, third).
STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
BUCKET_BITS = 18
#: Similarities below this count as none.
FLOOR = 0.4
#: Stands before and after each word.
MARK = 2
#: Texts that are looked at together hold about so many bytes, which keeps the arrays small.
SLICE = 1 << 19
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def subsequences(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By step: its span less one, and for each place whether a subsequence of one word begins there, and its bucket.

    `chars` are code points, with a MARK before, between and after words.
    """
    x, y, z = (chars * f for f in _FACTORS)
    inner = chars != MARK
    n = len(chars)
    for a, b in STEPS:
        k = max(0, n - b)
        own = np.ones(k, bool)
        for i in range(1, b):
            own &= inner[i : i + k]
        yield b, own, (x[:k] + y[a : a + k] + z[b : b + k]) >> np.uint32(32 - BUCKET_BITS)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, weight and word of every subsequence of three characters in each word, its begin and end included."""
    chars = np.frombuffer("".join([f"{chr(MARK)}{w}" for w in [*words, ""]]).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(words) + 1), [*(len(w) + 1 for w in words), 1])
    buckets, weights, owner = [], [], []
    for b, own, h in subsequences(chars):
        at = np.flatnonzero(own)
        buckets.append(h[at].astype(np.int64))
        weights.append(np.full(len(at), DECAY ** (b + 1), np.float32))
        owner.append(of[at])
    return np.concatenate(buckets), np.concatenate(weights), np.concatenate(owner)


def norms(lens: np.ndarray) -> np.ndarray:
    """The length of a word's vector of subsequences, which follows from its number of characters."""
    total = np.zeros(len(lens))
    for _, b in STEPS:
        total += np.maximum(lens + 2 - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(total)


class Landmarks:
    """Similarity of words to the landmarks: the cosine of their weighted subsequences."""

    def __init__(self, words: list[str]):
        self.words = words
        b, w, o = triples(words)
        used, where = np.unique(b, return_inverse=True)
        rows = np.zeros((len(used), len(words)), np.float32)
        np.add.at(rows, (where, o), w)
        norm = np.sqrt((rows**2).sum(axis=0))
        self.rows = rows / np.where(norm > 0, norm, 1)
        # by bucket: the landmarks that have it and their shares, one after the other, and the largest share
        place, self.mark = np.nonzero(self.rows)
        self.share = self.rows[place, self.mark]
        bound = np.searchsorted(place, np.arange(len(used) + 1))
        self.first, self.many = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        self.first[used], self.many[used] = bound[:-1], np.diff(bound)
        self.most = np.zeros(1 << BUCKET_BITS, np.float32)
        self.most[used] = self.rows.max(axis=1, initial=0)

    def kernel(self) -> np.ndarray:
        return self.rows.T @ self.rows

    def similar(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        k = len(self.words)
        b, w, o = triples(words)
        many = self.many[b]
        own = many > 0
        b, w, o, many = b[own], w[own], o[own], many[own]
        shares, marks = ragged(self.share, self.first[b], many), ragged(self.mark, self.first[b], many)
        out = np.bincount(np.repeat(o * k, many) + marks, np.repeat(w, many) * shares, len(words) * k).reshape(len(words), k)
        norm = norms(np.fromiter(map(len, words), np.int64, len(words)))
        out = np.minimum(out / np.where(norm > 0, norm, 1)[:, None], 1).astype(np.float32)
        out[out < FLOOR] = 0
        return out

    def may_be(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the words chars[start:end] may be like a landmark.

        A similarity is no more than the sum of the largest shares that any landmark has in the word's subsequences.
        """
        if not len(start):
            return np.zeros(0, bool)
        total = np.zeros(len(chars), np.float32)
        for b, own, h in subsequences(chars):
            part = self.most[h]
            part *= own
            part *= np.float32(DECAY ** (b + 1))
            total[: len(part)] += part
        # a subsequence that begins with the mark before a word is the word's; none begins at its last two places
        return np.add.reduceat(total, start - 1) >= (FLOOR - 1e-3) * norms(end - start)

    def bags(self, texts: list[str]) -> Bag:
        """The words of some texts that are like a landmark."""
        w = Words(texts)
        own = np.flatnonzero(self.may_be(w.chars, w.start, w.end))
        found = [w.lowered[a:b] for a, b in zip((w.start[own] - 1).tolist(), (w.end[own] - 1).tolist())]
        joined, at = w.joined()
        found, place = [*found, *joined], np.concatenate([w.start[own], at])
        number = {v: i for i, v in enumerate(dict.fromkeys(found))}
        sims = self.similar(list(number))
        row = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        hit = np.flatnonzero(sims.any(axis=1)[row]) if len(row) else row
        hit = hit[np.argsort(place[hit], kind="stable")]
        return Bag(sims[row[hit]], w.sentence(place[hit]), w.text(place[hit]), w.count)


@dataclass
class Bag:
    """Similarities of words to the landmarks, the words' sentences and texts (in order), and how many words each text has."""

    sims: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    count: np.ndarray

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """A row for each sentence with a word like some landmark: its most similar words' similarities; and its text."""
        first = np.flatnonzero(np.append(True, self.sentence[1:] != self.sentence[:-1])) if len(self.sentence) else self.sentence
        return (np.maximum.reduceat(self.sims, first, axis=0) if len(first) else self.sims), self.text[first]


_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For every code point: 1 a letter or digit, 2 white space, 3 the end of a sentence, 4 of a line, 0 any other."""
    if not _KIND:
        whole = map(chr, range(0x110000))
        table = np.fromiter((1 if c.isalnum() else 2 if c.isspace() else 0 for c in whole), np.uint8, 0x110000)
        table[[ord(c) for c in ".!?"]] = 3
        table[10] = 4
        _KIND.append(table)
    return _KIND[0]


class Words:
    """The words (runs of letters and digits) of some texts, in lower case."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        self.lowered = "\n".join(lower)
        points = np.frombuffer(f"\n{self.lowered}\n".encode("utf-32-le"), np.uint32)
        self.kind = kinds()[points]
        letter = self.kind == 1
        self.chars = np.where(letter, points, np.uint32(MARK))
        self.start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        lens = np.fromiter(map(len, lower), np.int64, len(lower))
        self.bounds = np.cumsum(lens + 1) - lens  # where each text begins in `chars`
        self.count = np.diff(np.append(np.searchsorted(self.start, self.bounds), len(self.start)))
        space = (self.kind == 2) | (self.kind == 4)
        over = self.kind == 4
        over[:-1] |= (self.kind[:-1] == 3) & space[1:]
        self.over = np.flatnonzero(over)
        self.space = np.flatnonzero(space)

    def text(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, "right") - 1

    def sentence(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.over, place)

    def joined(self) -> tuple[list[str], np.ndarray]:
        """Words with marks inside, without them, and three or more letters that stand alone in a row; and where they begin."""
        n = len(self.start)
        if n < 2:
            return [], np.zeros(0, np.int64)
        gap = self.start[1:] - self.end[:-1]
        same = (self.space[np.minimum(np.searchsorted(self.space, self.end[:-1]), len(self.space) - 1)] >= self.start[1:]) & (gap <= 3)
        lone = self.end - self.start == 1
        row = lone[1:] & lone[:-1] & (gap <= 3) & (self.sentence(self.start[1:]) - self.sentence(self.start[:-1]) <= 0)
        out, at = [], []
        for join, least in ((same & ~row, 2), (row, 3)):
            edge = np.diff(np.concatenate([[False], join, [False]]).astype(np.int8))
            begin, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            own = last - begin + 1 >= least
            begin, last = begin[own], last[own]
            out += [_BARE.sub("", self.lowered[a:b]) for a, b in zip((self.start[begin] - 1).tolist(), (self.end[last] - 1).tolist())]
            at.append(self.start[begin])
        return out, np.concatenate(at)


_BARE = re.compile(r"[\W_]+")


def tokens(text: str) -> list[str]:
    """The words of a text that are compared with the landmarks."""
    w = Words([text])
    return [w.lowered[a - 1 : b - 1] for a, b in zip(w.start.tolist(), w.end.tolist())] + w.joined()[0]


@dataclass(frozen=True)
class Model:
    """A trained machine, small whatever the corpus: landmarks, weights on their similarities, and the curve of the score."""

    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def figures(self, bag: Bag) -> np.ndarray:
        """A row for each text: the margin of its worst sentence, and logarithms of its words' positive margins and of its words."""
        sims, of = bag.sentences()
        worst = np.full(len(bag.count), self.bias)
        np.maximum.at(worst, of, sims @ self.weights + self.bias)
        ill = np.bincount(bag.text, np.maximum(bag.sims @ self.weights + self.bias, 0), len(bag.count))
        return np.stack([worst, np.log1p(ill), np.log1p(bag.count)], 1)

    def score(self, figures: np.ndarray) -> np.ndarray:
        return _logistic(figures @ self.curve[:-1] + self.curve[-1])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, rows: int, label: str = "toxic", text: str = "text") -> DataFrame:
    """_y and _t of about `rows` labelled rows at most, chosen by a hash of doc_id; null labels and texts are left out."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_y IS NOT NULL AND _id IS NOT NULL")
    # the sample is bounded by counting the labels first
    n = y.count()
    if n > rows:
        y = y.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return docs.select(F.col("doc_id").alias("_id"), F.col(text).alias("_t")).where("_t IS NOT NULL").join(y, "_id").select("_y", "_t")


def choose_landmarks(sample: DataFrame, most: int) -> list[str]:
    """Up to `most` words that go with the label, one after the other.

    A word's z-score compares its rows of both classes. A row of label 1 that holds a chosen word counts
    `EXPLAINED` times as much for each further one, so that the companions of an insult in its copies
    do not follow it. Of words much alike, one is taken. What comes to the driver is bounded by the sample.
    """
    words = sample.select("_y", F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("_w"))
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("p")).first()
    share = (total["p"] or 0) / max(1, total["n"])
    by = words.select("_y", F.explode("_w").alias("word")).where("length(word) BETWEEN 3 AND 40").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"))
    z = (F.col("p") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
    top = by.withColumn("z", z).where("z > 4 AND p > 2").orderBy(F.desc("z"), "word").limit(16 * most)
    found = [(r["word"], r["n"], r["p"]) for r in top.collect()]
    if not found:
        return []
    names = [w for w, _, _ in found]
    negative = np.array([n - p for _, n, p in found], np.float64)
    spark = sample.sparkSession
    listed = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)))), "word string, i int"))
    has = words.where("_y = 1").select(F.monotonically_increasing_id().alias("r"), F.explode("_w").alias("word")).join(listed, "word")
    rows = has.groupBy("r").agg(F.sort_array(F.collect_list("i")).alias("w")).collect()
    rows.sort(key=lambda r: r["w"])
    holds = np.zeros((len(rows), len(names)), bool)
    for i, r in enumerate(rows):
        holds[i, r["w"]] = True
    alike, weight, chosen = Landmarks(names).kernel(), np.ones(len(rows)), []
    free = np.ones(len(names), bool)
    while free.any() and len(chosen) < most:
        p = weight @ holds
        n = p + negative
        z = np.where(free & (p > 2), (p - share * n) / np.sqrt(n * share * (1 - share) + 1e-9), -1)
        best = int(np.argmax(z))
        if z[best] < 2:
            break
        chosen.append(names[best])
        free &= alike[best] < ALIKE
        weight[holds[:, best]] *= EXPLAINED
    return chosen


#: What a row counts for a further landmark after each that it holds, and the similarity from which words are alike.
EXPLAINED, ALIKE = 0.7, 0.5


def _over(sample: DataFrame, landmarks: list[str], schema: str, work) -> DataFrame:
    """work(labels, bag) for slices of the sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(landmarks)
        for batch in batches:
            for part in text_slices(batch, "_t", SLICE):
                yield work(part.column(0), marks.bags(part.column(1).to_pylist()))

    return sample.select("_y", "_t").mapInArrow(run, schema)


def _sentences(sample: DataFrame, landmarks: list[str], each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarities, document and label of the `each` sentences of every sampled document that are most like some landmark, and of one without words."""

    def work(labels: pa.Array, bag: Bag) -> pa.RecordBatch:
        sims, of = bag.sentences()
        bound = np.searchsorted(of, np.arange(len(labels) + 1))
        out = []
        for lo, hi in zip(bound[:-1], bound[1:]):
            own = sims[lo:hi]
            own = own[np.argsort(-own.max(axis=1), kind="stable")[:each]] if hi > lo else own
            out.append(np.concatenate([own, np.zeros((1, len(landmarks)))]).astype(np.float16).tobytes())
        return pa.RecordBatch.from_arrays([labels, pa.array(out, pa.binary())], names=["y", "sims"])

    rows = _over(sample, landmarks, "y int, sims binary", work).collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["sims"])))
    sims = [np.frombuffer(r["sims"], np.float16).reshape(-1, len(landmarks)) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(s) for s in sims])
    return np.concatenate(sims).astype(np.float64), doc, np.array([r["y"] for r in rows])


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 1000.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine of squared hinge loss by Newton's method; classes are weighed alike."""
    signs = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(rounds):
        inside = signs * (x1 @ w) < 1
        xs = x1[inside] * weight[inside, None]
        hess = np.diag(ridge) + 2 * cost / len(y) * xs.T @ x1[inside]
        grad = ridge * w + 2 * cost / len(y) * xs.T @ (x1[inside] @ w - signs[inside])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000, most: int = 32, each: int = 4, label: str = "toxic", text: str = "text") -> Model:
    """Trains on about `rows` labelled rows at most, with `most` landmarks and, of each of these rows, the `each` sentences most like a landmark.

    All three bounds hold for training alone; scores read all words of all texts.
    """
    small_batches(docs.sparkSession)
    sample = written(labelled(docs, labels, rows, label, text), "labelled")
    marks = choose_landmarks(sample, most)
    if not marks:
        return Model(("",), np.zeros(1), 0.0, np.array([0.0, 0.0, 0.0, -4.0]))
    sims, doc, y = _sentences(sample, marks, each)
    value, vector = np.linalg.eigh(Landmarks(marks).kernel().astype(np.float64))
    keep = value > 1e-4
    to_map = vector[:, keep] / np.sqrt(value[keep])  # the Nyström map
    x, label_of = sims @ to_map, y[doc]
    positive = label_of.copy()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(4):  # of a toxic document only the worst sentence counts as toxic, the others not at all
        w, b = _svm(x[positive >= 0], positive[positive >= 0])
        margin = x @ w + b
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, doc, margin)
        positive = np.where(label_of == 0, 0, np.where(margin >= worst[doc], 1, -1))
    model = Model(tuple(marks), to_map @ w, b, np.zeros(4))

    def work(labels: pa.Array, bag: Bag) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([labels, *map(pa.array, model.figures(bag).T)], names=["y", "a", "b", "c"])

    found = sorted(tuple(r) for r in _over(sample, marks, "y int, a double, b double, c double", work).collect())
    figures = np.array(found)
    return Model(model.landmarks, model.weights, b, _calibrate(figures[:, 1:], figures[:, 0]))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and shift of the logistic curve through the documents' figures, by Newton's method with a slight ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.array([1e-2] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = _logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, score and predicted (1 from a score of 0.5 on) of every row; other columns are dropped."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [*own.columns[:-1], "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(list(model.landmarks))
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                value = model.score(model.figures(marks.bags(part.column(part.num_columns - 1).to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{fields}, score double, predicted int")
