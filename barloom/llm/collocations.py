"""Phrase collocations: word-id suffix arrays of shards, counts of their LCP intervals, merged by key.

A shard is some megabytes of texts in one task. Its words become ids; prefix doubling sorts the suffixes of
all pieces by their first five words, and the intervals of common prefixes of n words or more are the
n-grams with their counts. Counts of equal n-grams are summed over shards.

Two passes read the texts. The first counts pairs of words, by hash; pairs that reach the least count
set bits of a bitmap, which is bounded (2^`BITS` bits). The second emits phrases all of whose pairs
have their bits set: no phrase that is frequent enough can lack one, and a bit set by chance only adds
rows, which the exact count by the phrase itself removes. Scores, cuts and the choice of phrases are joins
and aggregates over phrases that are frequent enough.

Defined results: a null text has no words, a null language is `und`, equal scores go by count and then by
phrase, rows of equal ids count each for itself. Without a phrase of the least count there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columnar import text_bytes, text_slices
from .workspace import stored

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Bytes of texts in a shard, or one text.
SHARD = 4 << 20
#: The bitmap of frequent pairs has 2^BITS bits at most, 2^MIN_BITS at least, and about SPARE bits a pair in between.
BITS, MIN_BITS, SPARE = 28, 16, 16
#: Parts that a language is ranked in before its best are ranked together.
SALTS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and their ranks from 1 on."""
    order = np.argsort(key)
    s = key[order]
    step = np.ones(len(key), np.int64)
    step[1:] = s[1:] != s[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """x shifted by n places, 0 at the end."""
    out = np.zeros_like(x)
    out[: max(0, len(x) - n)] = x[n:]
    return out


def _hashed(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class Shard:
    """The words of some texts as ids, with how many words each place has up to the end of its piece, at most LONGEST."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw, off = text_bytes(texts)
        kind = KIND[raw]
        word = kind == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.n = len(starts)
        doc = np.searchsorted(off, starts, "right") - 1
        breaks = np.cumsum(kind == BREAK, dtype=np.int32)[starts]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[word]])]).dictionary_encode()
        lang = langs.dictionary_encode()
        self.words, self.langs = coded.dictionary, lang.dictionary
        self.word = np.asarray(coded.indices, np.int32)
        self.lang = np.asarray(lang.indices, np.int32)[doc]
        # a word of another language is another word
        self.one = self.lang.astype(np.int64) * len(self.words) + self.word + 1
        if self.n and (self.one.max() + 1) >= 1 << 31:
            self.one = _dense(self.one)[1]
        linked = np.zeros(self.n, bool)
        if self.n:
            linked[:-1] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
        self.run = np.ones(self.n, np.int8)
        more = linked
        for i in range(1, LONGEST):
            self.run += more
            more = more & _ahead(linked, i)
        base = int(self.one.max(initial=0)) + 1
        self.pair_order, self.two = _dense(self.one * base + np.where(self.run >= 2, _ahead(self.one, 1), 0))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each distinct pair, its number and its hash."""
        ranks = self.two[self.pair_order]
        at = np.flatnonzero(np.diff(ranks, prepend=0))
        count = np.diff(at, append=len(ranks))
        places = self.pair_order[at]
        real = self.run[places] >= 2
        places, count = places[real], count[real]
        words, langs = _hashed(self.words), _hashed(self.langs)
        h = words[self.word[places]] * MIX[0] + words[self.word[places + 1]] * MIX[1] + langs[self.lang[places]] * MIX[2]
        h ^= h >> np.uint64(32)
        h *= MIX[3]
        h ^= h >> np.uint64(29)
        return places, count, h

    def phrases(self, bitmap: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, a place of each n-gram of 2 words or more that the bitmap lets pass, and its number."""
        places, _, h = self.pairs()
        set_ = _tested(bitmap, h)
        allowed = np.zeros(int(self.two.max(initial=0)) + 1, bool)
        allowed[self.two[places[set_]]] = True
        pair = allowed[self.two] & (self.run >= 2)
        run, more = np.ones(self.n, np.int8), pair
        for i in range(1, LONGEST):
            run += more
            more = more & _ahead(pair, i)
        own = np.flatnonzero(run >= 2)
        if not len(own):
            return
        # ranks by four words, then the order by five
        three, five = _ahead(self.two, 2), _ahead(self.one, 4)
        _, four = _dense(self.two[own] * (int(self.two.max()) + 1) + np.where(self.run[own] >= 3, three[own], 0))
        order = np.argsort(four * (int(self.one.max()) + 1) + np.where(self.run[own] >= 5, five[own], 0))
        at = own[order]
        a, b = at[1:], at[:-1]
        same = [self.two[a] == self.two[b]]
        same.append(same[0] & (_ahead(self.one, 2)[a] == _ahead(self.one, 2)[b]))
        same.append((four[order[1:]] == four[order[:-1]]) & same[1])
        same.append(same[2] & (five[a] == five[b]))
        for n, equal in enumerate(same, 2):
            # an LCP interval of n words: neighbours that agree in n words, all of which are there
            long = run[at] >= n
            start = np.ones(len(at), bool)
            start[1:] = ~(equal & long[1:] & long[:-1])
            first = np.flatnonzero(start)
            count = np.diff(first, append=len(at))
            real = long[first]
            yield n, at[first[real]], count[real]

    def texts(self, places: np.ndarray, n: int) -> pa.Array:
        ids = self.word[places[:, None] + np.arange(n)].ravel()
        words = self.words.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * n, pa.int32()), words), " ")


def _tested(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "_text", SHARD):
            _, count, h = Shard(part.column(0), part.column(1)).pairs()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count, pa.int64())], names=["h", "n"])


def frequent_pairs(own: DataFrame, least: int) -> np.ndarray:
    """The bitmap of the hashes of all pairs that occur `least` times; only the bitmap comes to the driver."""
    table, discard = stored(own.mapInArrow(_pairs, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "pairs")
    bits = min(BITS, max(MIN_BITS, int(SPARE * table.count()).bit_length()))
    place = F.col("h").bitwiseAND((1 << bits) - 1)
    # chunks of 2^15 bits as 512 longs
    longs = table.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << bits) - 1}) & 63 AS int))")).alias("v"))
    chunks = longs.groupBy(F.shiftright("at", 9).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct((F.col("at") % 512).alias("i"), "v"))).alias("l"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in chunks.select("chunk", "l.i", "l.v").toLocalIterator():
        out[r["chunk"] * 512 + np.array(r["i"], np.int64)] = r["v"]
    discard()
    return out.view(np.uint8)


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, k, phrase and n of all phrases of k words, up to LONGEST, that occur `least` times; k = 0 has the number of all words of a language."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bitmap = spark.sparkContext.broadcast(frequent_pairs(own, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "k", "phrase", "n"]
        for batch in batches:
            for part in text_slices(batch, "_text", SHARD):
                shard = Shard(part.column(0), part.column(1))
                if not shard.n:
                    continue
                total = np.bincount(shard.lang, minlength=len(shard.langs))
                yield pa.RecordBatch.from_arrays([shard.langs, pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total)), pa.array(total, pa.int64())], names=names)
                _, at, count = np.unique(shard.one, return_index=True, return_counts=True)
                for n, places, counts in [(1, at, count), *shard.phrases(bitmap.value)]:
                    if len(places):
                        yield pa.RecordBatch.from_arrays([shard.langs.take(pa.array(shard.lang[places])), pa.array(np.full(len(places), n, np.int32)), shard.texts(places, n), pa.array(counts, pa.int64())], names=names)

    found = own.mapInArrow(run, "lang string, k int, phrase string, n bigint")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= least))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases.

    A phrase is cut where the score floor(1000 * a * n / (l * r)) is lowest, at the first of equal ones.
    It is dropped if `share` percent of its occurrences lie in one longer phrase. It is enough to look at
    phrases of one word more: what lies between the two occurs no less often than the longer one.
    """
    grams, _ = stored(count_phrases(docs, text, lang, least), "phrases")
    totals, _ = stored(grams.where("k = 0").select("lang", F.col("n").cast("decimal(19,0)").alias("n")), "totals")
    parts = grams.where(f"k BETWEEN 1 AND {LONGEST - 1}").select("lang", "phrase", "n")
    found = grams.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    shorter = F.explode(F.array(F.expr("array_join(slice(w, 1, k - 1), ' ')"), F.expr("array_join(slice(w, 2, k - 1), ' ')")))
    longer = found.where("k > 2").select("lang", shorter.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_m"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(f"_m IS NULL OR 100 * _m < {int(share)} * a").drop("_m")

    cut = kept.select("lang", "phrase", "k", "a", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("c"))
    cut = cut.select("lang", "phrase", "a", "c", F.expr("array_join(slice(w, 1, c), ' ')").alias("_left"), F.expr("array_join(slice(w, c + 1, k - c), ' ')").alias("_right"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
    cut = cut.join(totals, "lang")
    score = F.expr("(cast(1000 AS decimal(4,0)) * cast(a AS decimal(18,0)) * n) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "c", "l", "r")).alias("s"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "s.l", "s.r", F.col("n").cast("long").alias("n"), "s.score")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
