"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Texts are cut into pretokens by the tokenizer's pattern. The distinct pretokens of a batch are put
into matrices by length; in every round each row merges its leftmost pair of least rank, found in a
hashed table of pairs, and the rows are compacted. A pretoken of more than ``LONG`` bytes has a matrix
of its own, in which a round merges every place of the least rank where that comes to the same.
Decoding gathers the bytes of the ids.

Null and empty texts have no ids. Repeated rows are encoded alike, a null doc_id is kept; other columns
are not touched.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import ragged, text_slices
from .workspace import small_batches

#: The longest pretoken in bytes that shares a matrix with others.
LONG = 128
#: Bytes of a matrix's row: the least of these that holds the pretoken.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, LONG)
#: Distinct pieces of text that a task keeps; then it forgets them all.
KEEP = 200_000
NONE = np.int32(2**31 - 1)
#: Marks a piece that has no space before it; no text holds a lone surrogate.
HEAD = "\ud800"
#: Fixed value: the pattern for which texts may be cut at single spaces before it is applied.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")


class PairTable:
    """Open addressing from a pair of ids to the id of the merged token; NONE for no such pair."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[at], self.vals[at] = keys[own], vals[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, vals, slot = keys[rest], vals[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.vals[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBPE:
    """Encoder and decoder for a file of ranks (one base64 token and its rank to a line)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find, self.spaced = regex.compile(pattern).findall, pattern == SPACED
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        self.token_len = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            self.token_len[rank] = len(token)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        by_rank = sorted((rank, token) for token, rank in self.ranks.items())
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.piece: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rows(self, tokens: list[bytes], ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Writes the ids of pretokens of LONG bytes at most to ids[start[i] :]; returns their counts."""
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        m = np.full((len(tokens), int(lens.max())), -1, np.int32)
        m[np.arange(m.shape[1]) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        row = np.arange(len(tokens))
        while len(row):
            k, cols = np.arange(len(row)), np.arange(m.shape[1])
            if m.shape[1] > 1:
                real = m[:, 1:] >= 0
                rank = np.full(real.shape, NONE, np.int32)
                rank[real] = self.pairs.find(m[:, :-1][real], m[:, 1:][real])
                at = rank.argmin(axis=1)  # the leftmost of the least
                best = rank[k, at]
            else:
                at, best = np.zeros(len(row), np.int64), np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                own = cols < lens[row[done], None]
                ids[(start[row[done], None] + cols)[own]] = m[done][own]
                m, at, best, row = m[~done], at[~done], best[~done], row[~done]
                if not len(row):
                    break
                k = np.arange(len(row))
            m[k, at] = best
            m = np.where(cols[:-1] <= at[:, None], m[:, :-1], m[:, 1:])  # closes the gap that the merge left
            lens[row] -= 1
            m = m[:, : lens[row].max()]
        return lens

    def merge_wide(self, token: bytes) -> np.ndarray:
        """The same merges in a matrix of one row: a round merges all places of the least rank, from left to right.

        Only where that would pass over a merge of lower rank that one of them makes possible does a round take the leftmost place alone.
        """
        m = self.of_byte[np.frombuffer(token, np.uint8)]
        rank = self.pairs.find(m[:-1], m[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]  # of overlapping places every other
            for own in (at, at[:1]):
                row = m.copy()
                row[own] = best
                row = np.delete(row, own + 1)
                new = own - np.arange(len(own))  # where the merged tokens stand now
                near = np.unique(np.concatenate([new - 1, new]))
                near = near[(near >= 0) & (near < len(row) - 1)]
                found = self.pairs.find(row[near], row[near + 1])
                if len(own) == 1 or not (found < best).any():
                    break
            m, rank = row, np.delete(rank, np.minimum(own + 1, len(rank) - 1))
            rank[near] = found
        return m

    def encode_pretokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of token i are ids[start[i] : start[i] + count[i]]."""
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        start, count = np.cumsum(lens) - lens, np.ones(len(tokens), np.int64)
        whole = np.fromiter(map(self.ranks.get, tokens, repeat(-1)), np.int64, len(tokens))
        ids = np.zeros(int(lens.sum()), np.int32)
        ids[start[whole >= 0]] = whole[whole >= 0]
        bucket = np.where(whole >= 0, -1, np.searchsorted(WIDTHS, lens))
        for i in np.flatnonzero(bucket == len(WIDTHS)):
            own = self.merge_wide(tokens[i])
            ids[start[i] : start[i] + len(own)], count[i] = own, len(own)
        for k, width in enumerate(WIDTHS):
            own, step = np.flatnonzero(bucket == k), max(1, (1 << 18) // width)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                count[part] = self.merge_rows([tokens[i] for i in part], ids, start[part])
        return ids, start, count

    def pieces_of(self, text: str) -> list[str]:
        """Parts that the pattern treats by themselves: cut before single spaces between other characters, or the text for another pattern.

        A part stands for itself after a space; with HEAD before it, for itself alone.
        """
        if not text:
            return []
        if not self.spaced:
            return [HEAD + text]
        parts = text.split(" ")
        head = parts[0]
        new = set(parts[1:]).difference(self.piece)
        if not head or head[-1].isspace() or "" in new or any(p[0].isspace() or p[-1].isspace() for p in new):
            head, *rest = _CLEAN_SPACE.split(text)
            return [HEAD + head, *(HEAD + " " + p if not p or p[0].isspace() or p[-1].isspace() else p for p in rest)]
        parts[0] = HEAD + head
        return parts

    def cut(self, piece: str) -> list[str]:
        """The pretokens of a piece."""
        if piece[:1] == HEAD:
            return self.find(piece[1:])
        if piece.isalpha():
            return [" " + piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.find(" " + piece)

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that are not known yet."""
        cut = list(map(self.cut, new))
        number: dict[str, int] = {}
        for own in cut:
            for t in own:
                number.setdefault(t, len(number))
        ids, start, count = self.encode_pretokens([t.encode() for t in number])
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64)
        ends = np.concatenate([[0], np.cumsum(count[at])])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])]
        self.piece.update(zip(new, range(len(self.piece), len(self.piece) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + ends[:-1]])
        self.count = np.concatenate([self.count, np.diff(ends)])
        self.flat = np.concatenate([self.flat, ragged(ids, start[at], count[at])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.piece) > KEEP:
            self._forget()
        parts = [self.pieces_of(t) for t in texts]
        if new := list(set().union(*parts).difference(self.piece)):
            self.learn(new)
        at = np.fromiter(map(self.piece.__getitem__, chain.from_iterable(parts)), np.int64)
        per_text = np.fromiter(map(len, parts), np.int64, len(parts))
        count = self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(per_text)])]
        return ragged(self.flat, self.start[at], count), np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes one after another, and the number of bytes of each text."""
        lens = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return ragged(self.token_bytes, self.token_start[ids], lens), np.diff(ends)


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def load(ranks_path: str, pattern: str) -> ByteBPE:
    """One coder to a worker process."""
    key = (ranks_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(ranks_path, pattern)
    return _LOADED[key]


def _offsets(counts: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", decode: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and `keep` columns, ids array<int> of every whole text, and with `decode` the bytes that the ids decode to.

    A null text counts as empty and gets an empty array. Other columns of `docs` are dropped; the
    number of rows stays, repeated ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(ranks_path, pattern)
        for batch in batches:
            for part in text_slices(batch):
                ids, counts = coder.encode(part.column(1).to_pylist())
                cols = [*part.columns, pa.Array.from_buffers(pa.list_(pa.int32()), len(counts), [None, _offsets(counts)], children=[pa.array(ids, pa.int32())])]
                if decode:
                    data, sizes = coder.decode(ids, counts)
                    cols.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, _offsets(sizes), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, "ids", "decoded"][: len(cols)])

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{fields}, ids array<int>" + ", decoded binary" * decode)


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode(..., decode=True) returns."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
