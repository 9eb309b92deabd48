"""Language identification by compression: every text is encoded with one raw-content dictionary a language.

A dictionary is plain text of its language. A text is normalised (lower case, ASCII letters and other
scripts' characters alone, one space between words, a word that repeats at once written once), cut into
pieces, and each piece compressed with every dictionary; the language of the smallest sum wins. The sizes
are code lengths, so 2 to the minus bits, tempered and normed over the languages, is the score. Where the
smallest two are close, `rejected` is true: there the general answer is that the language is not known.

Defined results: a null text and one without a letter get `und` and score 0; equal sizes go to the
language with more training texts, then to the lesser name; without any training text all is `und`.
Texts are read whole, whatever their length; rows with equal ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columnar import text_slices

UNKNOWN = "und"
#: Bytes of a dictionary, of the chunks that it is put together from, and of the pieces of a text.
DICTIONARY, CHUNK, PIECE = 32768, 256, 4096
#: Chunks that come to the driver for a language at most; a few more than a dictionary holds.
MOST = 2 * DICTIONARY // CHUNK
#: Before each piece: without something that surely compresses, short pieces would be stored, all at one size.
PAD = b" " * 64
#: Share of the bits of a margin that count as evidence; neighbouring matches are not independent.
TEMPER = 0.2
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Profiles:
    """Dictionaries by language, in order of preference among equal sizes."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def normalised(text: str) -> bytes:
    words = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
    return b" ".join(w for w, _ in groupby(words))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            langs, out = [], []
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                b = normalised(text)
                found = [b[k : k + CHUNK] for k in range(0, len(b), CHUNK)]
                langs += [lang] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["_lang", "_chunk"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", oversample: int = 16) -> Profiles:
    """Dictionaries of `DICTIONARY` bytes at most for every language of the labelled rows `docs`.

    Rows with a null text or language teach nothing. Texts are drawn by a hash of the text, so that about
    `oversample` dictionaries' bytes are read for each language, and copies count once; of their
    chunks the MOST of least hash come to the driver. The sample is bounded whatever the input.
    """
    own = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL AND length(_text) > 0")
    totals = own.groupBy("_lang").agg(F.sum(F.octet_length("_text")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    if not totals:
        return Profiles((), ())
    span = 1 << 40
    limits = F.create_map(*[F.lit(x) for r in totals for x in (r["_lang"], min(span, int(span * oversample * DICTIONARY / r["size"]) + 1))])
    drawn = own.where(F.pmod(F.xxhash64("_text"), F.lit(span)) < limits[F.col("_lang")])
    pieces = drawn.mapInArrow(_chunks, "_lang string, _chunk binary").distinct().withColumn("_h", F.xxhash64("_chunk"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_chunk"))
    found: dict[str, list[bytes]] = {}
    for r in pieces.withColumn("_n", first).where(F.col("_n") <= MOST).orderBy("_lang", "_n").collect():
        found.setdefault(r["_lang"], []).append(bytes(r["_chunk"]))
    order = [r["_lang"] for r in sorted(totals, key=lambda r: (-r["n"], r["_lang"])) if r["_lang"] in found]
    return Profiles(tuple(order), tuple(b" ".join(found[k])[:DICTIONARY] for k in order))


def compressors(profiles: Profiles) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in profiles.dictionaries:
        # frames without headers that would cost bytes; matches from three bytes on
        p = zstandard.ZstdCompressionParameters.from_level(5, source_size=PIECE, dict_size=DICTIONARY, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return out


def sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the text under each dictionary."""
    b = normalised(text)
    pieces = [PAD + b[k : k + PIECE] for k in range(0, len(b), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in coders]


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", narrow: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, lang_pred, score (0 to 1), margin and rejected of every row.

    margin is by how much the second smallest encoding is longer than the smallest, as a share of it;
    below `narrow` a prediction is rejected, and so is `und`. With one language there is no second: margin 1.
    """
    names = np.array([*profiles.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = compressors(profiles)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                n = part.num_rows
                best, score, margin = np.full(n, len(coders)), np.zeros(n), np.zeros(n)
                for i, t in enumerate(part.column(0).to_pylist()):
                    if t is None or not coders:
                        continue
                    s = np.array(sizes(t, coders), np.float64)
                    best[i] = int(np.argmin(s))
                    least = s[best[i]]
                    score[i] = 1 / np.exp2(-8 * TEMPER * (s - least)).sum()
                    margin[i] = (np.partition(s, 1)[1] - least) / max(least, 1.0) if len(s) > 1 else 1.0
                own = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(margin)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *own], names=[*part.schema.names[1:], "lang_pred", "score", "margin"])

    readable = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    own = docs.select(readable.alias("_text"), "doc_id", *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    coded = own.mapInArrow(run, f"{fields}, lang_pred string, score double, margin double")
    return coded.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < narrow))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4))
