"""Benchmark decontamination by template canonicalisation.

Words lose surrounding marks and their case; numbers, units after numbers and names (capitalised inside a
sentence, in any script with case) become typed slots. Up to RUN names in a row are one slot. A capitalised
word that may begin a sentence (after . ! ? : or a line break) is either a name or a plain word: its windows
are taken in both forms, in items and in documents alike. Windows with names are also taken with the names
as plain words, so that texts in capitals or without any are found. Signs of arithmetic between numbers and
variables are plain words.

Windows have five template words, or as many more as it takes to hold three plain ones. Where LONGEST words
do not, the first five are joined on their values as well: in rows of numbers the values are the text. An
item's windows that its end cuts short count only if it has no others. Windows of documents are hash-joined
with those of the benchmark. The slots of one alignment give a one-to-one mapping of the item's values to
the document's, by the number of places that speak for each pair; windows whose slots contradict it do not
count, unless their values are the item's own. A document leaks an item if windows that agree cover `least`
of the item's.

A document that leaks an item holds one of the item's rarest windows: of n windows those that can't all be
missing, by the number of items that have them. Documents and items are paired by these alone, so a phrase
that many items share pairs no documents with items by itself; then the windows of the pairs are joined.

A bitmap of fixed size, made of the benchmark's window hashes, leaves out most windows before the
join; a larger benchmark only fills it more. An item of fewer than five template words, signs aside, is one window of its
very words and is found where it stands as a line of its own: in running text so few words say nothing.
Items without words match nothing.

Nulls: rows with a null id or text match nothing. Repeated rows of one id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rolling
from .columnar import text_bytes, text_slices
from .workspace import small_batches, written

WINDOW = 5
#: Windows grow until they hold so many plain words,
PLAIN = 3
#: but not beyond so many template words.
LONGEST = 12
#: So many names in a row are one slot.
RUN = 4
#: So many words of a window may be read as names where they may begin a sentence.
NAMED = 2
#: log2 of the bitmap's bits.
BITS = 24
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres mile miles kilometers kilometres grams gram kilograms liters litres euro euros eur dollar dollars usd cent cents percent % kw kwh w mb gb tb kb hz khz mhz ghz"
).split()

_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_OPERATOR = np.zeros(256, bool)
_OPERATOR[[ord(c) for c in "+-*/=<>^"]] = True
_UPPER = np.array([chr(c).isupper() for c in range(1 << 16)])
_LOWER = np.array([chr(c).islower() for c in range(1 << 16)])
#: Lower case of the code points that two bytes hold, where it takes two bytes as well.
_SMALL = np.array([ord(s) if len(s := chr(c).lower()) == 1 and 128 <= ord(s) < 2048 else c for c in range(2048)])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _hash_words(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words))
    return np.sort(rolling.Segments(raw).of(offsets[:-1], offsets[1:]))


_UNIT_HASHES = _hash_words([u for u in UNITS if u != "%"])


def _points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points that begin at `at`, 0 beyond three bytes, and their lengths."""
    padded = np.append(raw, np.zeros(3, np.uint8))
    a, b, c = (padded[at + k].astype(np.int64) for k in range(3))
    n = 1 + (a >= 0xC0) + (a >= 0xE0) + (a >= 0xF0)
    return np.choose(n - 1, [a, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63, 0 * a]), n


def _small(raw: np.ndarray) -> np.ndarray:
    """Bytes of texts in lower case: A-Z and the letters of two bytes whose small ones have two as well."""
    out = rolling.lower(raw)
    if len(at := np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0))):
        point = _SMALL[(raw[at].astype(np.int64) & 31) << 6 | raw[at + 1] & 63]
        out[at], out[at + 1] = 0xC0 | point >> 6, 0x80 | point & 63
    return out


class Templates:
    """Template windows of a batch of texts: hash, text, place, and the values of the slots (0 for plain words)."""

    def __init__(self, texts: pa.Array, items: bool = False):
        raw, offsets = text_bytes(texts)
        start, end, first = rolling.words(raw, offsets)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        newline = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(raw == 10, out=newline[1:])
        begins = np.ones(len(start), bool)  # of a sentence; a word of marks alone still ends one
        if len(start):
            begins[1:] = (text[1:] != text[:-1]) | _STOP[raw[end[:-1] - 1]] | (newline[start[1:]] > newline[end[:-1]])
        s, e = start.copy(), end.copy()
        while len(move := np.flatnonzero((s < e) & _MARK[raw[np.minimum(s, len(raw) - 1)]])):
            s[move] += 1
        while len(move := np.flatnonzero((s < e) & _MARK[raw[np.maximum(e - 1, 0)]])):
            e[move] -= 1
        if len(start):
            sign = (end - start == 1) & _OPERATOR[raw[start]]
            beside = np.append(_DIGIT[raw[start[1:]]], False) | np.append(False, _DIGIT[raw[end[:-1] - 1]])
            sign &= (raw[start] != ord("-")) | beside  # elsewhere it is a dash
            s[sign], e[sign] = start[sign], end[sign]
        real = s < e
        joined = np.zeros(len(start), bool)  # to the word before, with no mark between
        if len(start):
            # the point of an abbreviation such as Dr. or of an initial is no mark
            point = (end - e == 1) & (e - s <= 3) & (raw[end - 1] == ord(".")) & _UPPER[_points(raw, start)[0]]
            joined[1:] = (s == start)[1:] & (((e == end) | point) & real)[:-1] & (text[1:] == text[:-1])
        signs = real & (e - s == 1)
        signs[signs] = _OPERATOR[raw[s[signs]]]
        s, e, text, begins, self.joined, signs = s[real], e[real], text[real], begins[real], joined[real], signs[real]
        self.spelt = rolling.Segments(_small(raw)).of(s, e) if len(raw) else np.zeros(0, np.uint64)
        digits = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_DIGIT[raw], out=digits[1:])
        others = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(~(_DIGIT[raw] | _MARK[raw]), out=others[1:])
        number = digits[e] > digits[s]
        if len(s):
            number &= (others[e] == others[s]) | (_DIGIT[raw[s]] & (others[e] - others[s] <= 3))
        unit = np.zeros(len(s), bool)
        if len(s) > 1:
            at = np.minimum(np.searchsorted(_UNIT_HASHES, self.spelt[1:]), len(_UNIT_HASHES) - 1)
            unit[1:] = (_UNIT_HASHES[at] == self.spelt[1:]) & number[:-1] & (text[1:] == text[:-1])
        one, n = _points(raw, s)
        two, _ = _points(raw, np.minimum(s + n, np.maximum(e - 1, 0)))
        capital = _UPPER[one] & _LOWER[two] & (s + n < e) & ~number & ~unit
        self.name, self.either, self.slot = capital & ~begins, capital & begins, number | unit
        self.word = np.where(number, _NUMBER, np.where(unit, _UNIT, self.spelt))
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))
        self.stop = self.first[text + 1]
        # words of a run of names but those that begin a slot
        run = np.zeros(len(s), bool)
        run[1:] = self.joined[1:] & self.name[1:] & self.name[:-1]
        index = np.arange(len(s))
        inner = run & ((index - np.maximum.accumulate(np.where(run, 0, index))) % RUN > 0)
        self.ordinal = np.append(0, np.cumsum(~inner))
        self.said = np.append(0, np.cumsum(~(inner | signs)))  # words but for signs of arithmetic
        self._windows(np.flatnonzero(~inner), index if not items else np.flatnonzero(~inner), text, items)
        self._short_lines(text, text if items else text * (1 + newline[-1]) + newline[s])
        self.text = text[self.at] if len(self.at) else self.at

    def _windows(self, starts: np.ndarray, folded: np.ndarray, text: np.ndarray, items: bool) -> None:
        at, h, form, size, valued, cut = self._grow(starts)
        plain = form == 0
        whole, own = np.zeros(len(text), bool), np.zeros(len(text), np.uint64)
        known = np.zeros(len(text), bool)
        for some in (plain & valued, plain & ~valued):  # a window that grew comes before its first five words with values
            own[at[some]], known[at[some]] = h[some], True
        whole[at[plain & ~valued]] = True
        if items and len(text):
            others = np.zeros(len(self.first) - 1, bool)
            others[text[whole]] = True
            ended = np.zeros(len(text), bool)
            ended[cut] = True
            few = self.said[self.first[1:]] - self.said[self.first[:-1]] < WINDOW
            known &= (whole | ~(ended & others[text])) & ~few[text]
            keep = known[at] & (~valued | ~whole[at])
            at, h, form, size = at[keep], h[keep], form[keep], size[keep]
            folded = folded[known[folded]]
        # with names as plain words, where there are any
        names = np.append(0, np.cumsum(self.name))
        folded = folded[names[np.minimum(folded + LONGEST, self.stop[folded])] > names[folded]]
        at2, h2, _, size2, valued2, _ = self._grow(folded, names=False)
        new = ~(known[at2] & (own[at2] == h2)) & ~valued2
        at2, h2, size2 = at2[new], h2[new], size2[new]
        self.at, self.hash = np.concatenate([at, at2]), np.concatenate([h, h2])
        self.form = np.concatenate([form, np.full(len(at2), -1)])  # -1: no names
        self.own, self.size = own[self.at], np.concatenate([size, size2])  # size 0: no slots

    def _grow(self, at: np.ndarray, names: bool = True) -> tuple[np.ndarray, ...]:
        """Start, hash, form, size and whether values are hashed too of all windows from the given words, then the starts cut by their text's end.

        The form has a bit for each word that is read as a name where it may begin a sentence.
        """
        # windows without words to choose and with three plain ones are hashed at once, the others word by word
        segments = rolling.Segments(self.word)
        count = lambda x: np.append(0, np.cumsum(x))
        end = np.minimum(at + WINDOW, self.stop[at])
        names_, slots = count((self.name | self.either) & names), count(self.slot)
        easy = (end - at == WINDOW) & (names_[end] == names_[at]) & (WINDOW - (slots[end] - slots[at]) >= PLAIN)
        now = at[easy]
        at = at[~easy]
        zero = np.zeros(len(at), np.int64)
        found = [(now, segments.of(now, now + WINDOW), 0 * now, 0 * now + WINDOW, now < 0)]
        at, pos, n, plain, run, named, form = at, at, zero, zero, zero, zero, zero
        h, values = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        power = rolling.Segments(np.zeros(LONGEST, np.uint64)).power
        cut = [zero[:0]]
        while len(at):
            inside = pos < self.stop[at]
            j = np.minimum(pos, len(self.word) - 1)
            name = self.name[j] & inside & names
            goes_on = name & self.joined[j] & (run > 0) & (run < RUN)
            full = (n >= WINDOW) & ~goes_on
            done = full & (plain >= PLAIN)
            few = full & (n == WINDOW) & ~done
            found += [(at[done], rolling.mix(h[done]), form[done], n[done], np.zeros(done.sum(), bool)), (at[few], rolling.mix(rolling.mix(h[few]) ^ values[few]), form[few], n[few], np.ones(few.sum(), bool))]
            cut.append(at[~inside & ~done & (form == 0)])
            go = inside & ~done & (goes_on | (n < LONGEST))
            at, pos, n, plain, run, named, form, h, values, j, name = (x[go] for x in (at, pos, n, plain, run, named, form, h, values, j, name))
            fork = np.flatnonzero(self.either[j] & (named < NAMED)) if names else j[:0]
            at, pos, n, plain, run, named, form, h, values, j = (np.append(x, x[fork]) for x in (at, pos, n, plain, run, named, form, h, values, j))
            name = np.append(name, np.ones(len(fork), bool))
            form[len(form) - len(fork) :] |= np.int64(1) << (pos - at)[len(form) - len(fork) :]
            named[len(form) - len(fork) :] += 1
            slot = self.slot[j]
            goes_on = name & self.joined[j] & (run > 0) & (run < RUN)
            value = np.where(name | slot, self.spelt[j], np.uint64(0))
            h += np.where(goes_on, np.uint64(0), (np.where(name, _NAME, self.word[j]) + np.uint64(1)) * power[n])
            values = values * np.uint64(3) + (value + np.uint64(1)) * power[n]
            n, plain, run = n + ~goes_on, plain + ~(name | slot), np.where(name, np.where(goes_on, run + 1, 1), 0)
            pos = pos + 1
        return (*(np.concatenate(x) for x in zip(*found)), np.concatenate(cut))

    def _short_lines(self, text: np.ndarray, line: np.ndarray) -> None:
        """Adds a window for each line (of an item: the whole of it) of fewer than WINDOW template words, signs of arithmetic aside."""
        if not len(line):
            return
        first = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])))
        last = np.append(first[1:], len(line))
        own = np.flatnonzero(self.said[last] - self.said[first] < WINDOW)
        a, n = first[own], (last - first)[own]
        h = rolling.mix(rolling.Segments(self.spelt).of(a, a + n) + n.astype(np.uint64) * _NAME)
        self.at, self.form = np.concatenate([self.at, a]), np.append(self.form, np.zeros(len(a), np.int64))
        self.own, self.hash = np.concatenate([self.own, h]), np.concatenate([self.hash, h])
        self.size = np.append(self.size, np.zeros(len(a), np.int64))

    def _slots(self, at: np.ndarray, form: np.ndarray) -> np.ndarray:
        """The values of the slots of LONGEST template words from each place on, 0 for plain words."""
        out = np.zeros((len(at), LONGEST), np.uint64)
        n, run, rows = np.full(len(at), -1), np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(LONGEST * RUN):
            own = np.flatnonzero((at + k < self.stop[at]) & (n < LONGEST)) if len(at) else rows
            if not len(own):
                break
            j, f = at[own] + k, form[own]
            name = (f >= 0) & (self.name[j] | (f >> k & 1 > 0))
            goes_on = name & self.joined[j] & (run[own] > 0) & (run[own] < RUN)
            n[own] += ~goes_on
            run[own] = np.where(name, np.where(goes_on, run[own] + 1, 1), 0)
            inside = n[own] < LONGEST
            row, col, value = rows[own[inside]], n[own[inside]], np.where(name | self.slot[j], self.spelt[j], np.uint64(0))[inside]
            out[row, col] = np.where(goes_on[inside], rolling.mix(out[row, col] ^ (value + _NUMBER)), value)
        return out

    def rows(self, keep: np.ndarray, ids: pa.Array) -> list[pa.Array]:
        at, text = self.at[keep], self.text[keep]
        inside = np.arange(LONGEST) < self.size[keep][:, None]
        values = np.where(inside, self._slots(at, self.form[keep]), np.uint64(0)).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * LONGEST, pa.int32()), pa.array(values))
        place = self.ordinal[at] - self.ordinal[self.first[text]]
        longs = [np.asarray(x, np.int64) for x in (at - self.first[text], place, self.hash[keep].view(np.int64), self.own[keep].view(np.int64))]
        return [ids.take(pa.array(text)), *map(pa.array, longs), lists]


def windows(table: DataFrame, key: str, text: str = "text", bitmap: np.ndarray | None = None) -> DataFrame:
    """key, word and at (place in words and in template words), h, own (h of the form without names at sentence starts) and slots of the template windows of each whole text; with a bitmap, of those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                t = Templates(part.column(1), items=bitmap is None)
                if bitmap is None:
                    keep = np.arange(len(t.hash))
                else:
                    bit = t.hash >> np.uint64(64 - BITS)
                    keep = np.flatnonzero(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays(t.rows(keep, part.column(0)), names=[key, "word", "at", "h", "own", "slots"])

    own = table.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).where(f"`{key}` IS NOT NULL AND text IS NOT NULL")
    return own.mapInArrow(run, f"`{key}` long, word long, at long, h long, own long, slots array<long>")


def _bitmap(bench: DataFrame) -> np.ndarray:
    """Bits of the benchmark's window hashes: 2**BITS / 64 rows at most come to the driver, whatever the benchmark."""
    bit = F.shiftrightunsigned("h", 64 - BITS)
    rows = bench.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(63).alias("bit")).distinct()
    rows = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 64, np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (distinct ones of the item), n_found, coverage and first_at (word) of each leaked item."""
    small_batches(docs.sparkSession)
    bench = written(windows(benchmark, "item_id", text), "benchmark")
    items = bench.groupBy("item_id").agg(F.countDistinct("own").alias("n_windows"))
    found = written(windows(docs, "doc_id", text, _bitmap(bench)).drop("own"), "hits")
    # an item's rarest windows, so many that a leak has one of them, pair it with documents
    shared = bench.groupBy("h").agg(F.countDistinct("item_id").alias("_items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("_items", "own"))
    rare = bench.join(shared, "h").groupBy("item_id", "own").agg(F.max("_items").alias("_items")).withColumn("_rank", rank).join(items, "item_id")
    rare = rare.where(F.col("_rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * F.lit(least) - F.lit(1e-9)) + 1)
    keys = bench.join(rare.select("item_id", "own"), ["item_id", "own"]).select("item_id", "h").distinct()
    paired = found.select("doc_id", "h").distinct().join(keys, "h").select("doc_id", "item_id").distinct()
    pairs = paired.join(found, "doc_id").join(bench.select("item_id", "h", "own", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")), ["item_id", "h"])
    slots = F.filter(F.transform(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x, k: F.struct((F.col("item_at") + k).alias("i"), x["a"].alias("a"), x["b"].alias("b"))), lambda x: x["a"] != 0)
    pairs = pairs.select("doc_id", "item_id", "own", "word", (F.col("at") - F.col("item_at")).alias("shift"), slots.alias("slots"))
    lined = pairs.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.struct("own", "word", "slots")).alias("ws"))
    lined = lined.withColumn("all", F.array_distinct(F.flatten("ws.slots")))
    # places that speak for each pair of values; of as many, the pair of equal values comes first
    count = lambda x: F.size(F.filter("all", lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"])))
    lined = lined.withColumn("votes", F.array_distinct(F.transform("all", lambda x: F.struct(count(x).alias("n"), (x["a"] == x["b"]).alias("same"), x["a"].alias("a"), x["b"].alias("b")))))
    rival = lambda x, y: ((y["a"] == x["a"]) | (y["b"] == x["b"])) & (y > x)
    lined = lined.withColumn("map", F.transform(F.filter("votes", lambda x: ~F.exists("votes", lambda y: rival(x, y))), lambda x: F.struct(x["a"], x["b"])))
    fits = lambda x: F.array_contains("map", F.struct(x["a"], x["b"]))
    good = F.filter("ws", lambda w: F.forall(w["slots"], lambda x: x["a"] == x["b"]) | F.forall(w["slots"], fits))
    by = lined.select("doc_id", "item_id", F.explode(good).alias("w")).groupBy("doc_id", "item_id").agg(F.countDistinct("w.own").alias("n_found"), F.min("w.word").alias("first_at"))
    out = by.join(items, "item_id").select("doc_id", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("coverage"), "first_at")
    return out.where(F.col("coverage") >= least)
