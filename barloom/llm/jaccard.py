"""N-gram Jaccard join by a grouped prefix join.

A document is its set of distinct 3-word shingles, hashed to 64 bits. Documents of equal sets form a
class. The sets are put in one global order, by hash, with the most frequent shingles last; two sets
whose Jaccard similarity reaches the threshold share a shingle among the first few of each, their
prefixes. Classes with the same prefix and size are collapsed into one group before the join. In each
posting (the groups that share a prefix shingle) pairs are filtered by size, by place and by counts of
shingles in bins, which bound the overlap from above; a group of several classes has the greatest count of
each bin. What remains connected are candidate clusters; their groups are expanded, and members are
verified by their whole sets.

No pair is emitted: postings and clusters give spanning links only, which lose no component. Postings
and clusters over a limit are worked on as pairs of blocks. Frequent shingles go last exactly by a
count of more than 256 or, in large tables, of one in `hot_share` rows; their number is at most
`hot_share` times the mean prefix length.

Nulls: a document without words has no shingles and is linked with nothing; a row with a null doc_id
has a null component. Rows of equal doc_id are one document. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .columnar import text_bytes, text_slices
from .components import components
from .seeds import plain
from .workspace import written

#: Bins of a set: a power of two, this many at least, so many that a bin has 4 to 8 shingles on average, in sets of over
#: LARGE 8 to 16. Sets that share nothing then have bounds of about 0.7 to 0.86 of their size, below any overlap of
#: similar ones (0.89 of it at a similarity of 0.8).
BINS, LARGE = 32, 4096
#: Members of a posting, and shingles of a cluster, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
#: Shingles of over one in so many rows go last. A posting of rarer ones compares its pairs, whose number must not grow with
#: the table: 256 rows bound it up to four million rows.
HOT_SHARE = 16_000
#: Members of a posting up to which all its pairs are compared at once, and pairs at once.
SQUARE, PAIRS = 256, 1 << 20


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(texts)
    start, end, first = rolling.words(raw, offsets)
    hashes = rolling.Segments(rolling.word_hashes(rolling.lower(raw), start, end))
    shingles = hashes.windows(size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:  # fewer words: the whole sequence, told apart by its length
            out.append(rolling.mix(hashes.of(np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _prefix(n: int, percent: int) -> int:
    """How many of the first of n shingles a similar set must meet."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _map(docs: DataFrame, schema: str, work) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays(work(part), names=names)

    return docs.mapInArrow(run, schema)


def classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n (size of the set), key (the same for equal sets; null for an empty one) and first (the prefix by hash) of every row of plain(docs)."""

    def work(part: pa.RecordBatch) -> list:
        sets = _sets(part.column(1), size)
        first = [s[: _prefix(len(s), percent)].view(np.int64) for s in sets]
        return [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.binary()), pa.array(first, pa.list_(pa.int64()))]

    return _map(docs, "doc_id long, n long, key binary, first array<long>", work)


def frequent(known: DataFrame, rows: int, hot_share: int) -> np.ndarray:
    """Shingles that more than rows / hot_share documents have in their prefixes by hash, sorted."""
    least = max(256, rows // hot_share)
    hot = known.select(F.explode("first").alias("token")).groupBy("token").count().where(F.col("count") > least).select("token")
    return np.sort(hot.toArrow().column("token").to_numpy().view(np.uint64))


def _order(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    if not len(hot) or not len(s):
        return s
    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    return np.concatenate([s[~late], s[late]])


def _bins(s: np.ndarray) -> np.ndarray:
    """Shingles by some bits of their hash; halves of the bins can be folded together."""
    count = BINS
    while (8 if len(s) <= LARGE else 16) * count < len(s):
        count *= 2
    bins = np.bincount((s >> np.uint64(11) & np.uint64(count - 1)).astype(np.int64), minlength=count)
    # a count beyond a byte is a chance of nothing; such a set goes without bins, which is a bound as well
    return bins.astype(np.uint8) if bins.max() < 256 else np.zeros(0, np.uint8)


def profiles(docs: DataFrame, hot: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, n, key, prefix and bins of each row with shingles."""

    def work(part: pa.RecordBatch) -> list:
        sets = _sets(part.column(1), size)
        own = np.flatnonzero([len(s) > 0 for s in sets])
        sets = [sets[i] for i in own]
        prefix = [_order(s, hot)[: _prefix(len(s), percent)].view(np.int64) for s in sets]
        bins = [_bins(s).tobytes() for s in sets]
        return [part.column(0).take(pa.array(own)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bins, pa.binary())]

    return _map(docs, "doc_id long, n long, key binary, prefix array<long>, bins binary", work)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by integer keys, cut anew to hold whole groups, with the groups' bounds."""

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows + 1, bool)
        change[[0, -1]] = True
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:-1] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            kept.append(batch.slice(lo, rows))
            n += kept[-1].num_rows
            if n < rows:
                continue
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            cut = bounds(whole)
            if len(cut) > 2:
                yield whole.slice(0, int(cut[-2])), cut[:-1]
                whole = whole.slice(int(cut[-2]))
            kept, n = [whole], 0
    if kept:
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        yield whole, bounds(whole)


def _spanning(near, m: int) -> list[tuple[int, int]]:
    """A spanning forest of m things, where near(i, others) tells which of `others` i is linked with."""
    links: list[tuple[int, int]] = []
    left = np.arange(m)
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = near(i, left)
            found = left[hit]
            links += [(i, int(j)) for j in found]
            front += found.tolist()
            left = left[~hit]
    return links


def _folded(bins: np.ndarray, count: int) -> np.ndarray:
    """Rows of bins as rows of `count` bins."""
    return bins if bins.shape[1] == count else bins.reshape(len(bins), -1, count).sum(axis=1, dtype=np.uint16)


class _Bounds:
    """Upper bounds of the overlaps of a batch's sets, by their bins; without bins the smaller size."""

    def __init__(self, n: np.ndarray, bins: pa.Array):
        self.n = n
        raw = [None if x is None else np.frombuffer(x, np.uint8) for x in bins.to_pylist()]
        self.count = np.array([0 if x is None else len(x) for x in raw])
        self.level: dict[int, np.ndarray] = {}
        self.row = np.zeros(len(n), np.int64)
        for k in np.unique(self.count).tolist():
            own = np.flatnonzero(self.count == k)
            self.row[own] = np.arange(len(own))
            self.level[k] = np.stack([raw[i] for i in own]) if k else np.zeros((len(own), 0), np.uint8)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For places x and y, pair by pair."""
        out = np.minimum(self.n[x], self.n[y])
        for k in np.unique(self.count[x]).tolist():
            for j in np.unique(self.count[y]).tolist():
                least = min(j, k)
                whole = np.flatnonzero((self.count[x] == k) & (self.count[y] == j)) if least else np.zeros(0, np.int64)
                step = max(1, (1 << 21) // max(j, k, 1))  # pairs at once, by the room they take
                for lo in range(0, len(whole), step):
                    own = whole[lo : lo + step]
                    a = _folded(self.level[k][self.row[x[own]]], least)
                    b = _folded(self.level[j][self.row[y[own]]], least)
                    out[own] = np.minimum(a, b).sum(axis=1, dtype=np.int64)
        return out


def _forest(x: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links x < y of m things, few that connect the same: the least of each thing, and those between trees that these leave."""
    least = np.full(m, m)
    np.minimum.at(least, y, x)
    root = np.minimum(least, np.arange(m))
    while not np.array_equal(root, root[root]):
        root = root[root]
    keep = (least[y] == x) | (root[x] != root[y])
    return x[keep], y[keep]


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the pairs of a posting that the filters leave.

    Postings of equal size are compared together: first members with all others, then, where nothing is linked
    with the first, the others with each other. Where some are, and in large postings, links are followed.
    """
    for batch, cut in whole_groups(batches, ["token", "i", "j"], 16_000):
        ids = batch.column("grp").to_numpy()
        n, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
        bounds = _Bounds(n, batch.column("bins"))
        a, b = [], []

        def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """By size, by what can follow the shared place, and by bins."""
            need = percent * (n[x] + n[y])  # noqa: B023  of (100 + percent) times the overlap
            rest = np.minimum(n[x] - at[x], n[y] - at[y]) + np.minimum(at[x], at[y])  # noqa: B023
            ok = ((100 + percent) * rest >= need) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))  # noqa: B023
            own = np.flatnonzero(ok)
            ok[own] = (100 + percent) * bounds.of(x[own], y[own]) >= need[own]  # noqa: B023
            return ok

        def put(x: np.ndarray, y: np.ndarray) -> None:
            a.append(ids[x])  # noqa: B023
            b.append(ids[y])  # noqa: B023

        sizes = np.diff(cut)
        for m in np.unique(sizes[sizes > 1]).tolist():
            starts = cut[:-1][sizes == m]
            step = max(1, PAIRS // (m * m))
            for own in [starts[i : i + step] for i in range(0, len(starts), step)] if m <= SQUARE else []:
                x, y = np.repeat(own, m - 1), (own[:, None] + np.arange(1, m)).ravel()
                hit = close(x, y).reshape(-1, m - 1)
                every, some = hit.all(axis=1), hit.any(axis=1)
                whole = np.repeat(every, m - 1)
                put(x[whole], y[whole])
                i, j = np.triu_indices(m - 1, 1)
                x, y = (own[~some, None] + 1 + i).ravel(), (own[~some, None] + 1 + j).ravel()
                ok = close(x, y)
                put(*_forest(x[ok], y[ok], len(ids)))
                starts = np.concatenate([starts[len(own) :], own[some & ~every]])
            for lo in starts.tolist():
                if links := _spanning(lambda i, js, lo=lo: close(np.full(len(js), i + lo), js + lo), m):  # noqa: B023
                    put(*(np.array(links).T + lo))
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the similar pairs of a cluster, by whole sets."""
    for batch, cut in whole_groups(batches, ["cluster", "i", "j"], 64):
        ids, bodies = batch.column("doc_id").to_numpy(), batch.column("shingles")
        a, b = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in bodies[lo:hi]]
            size = np.array([len(s) for s in sets], np.int64)
            vocab, flat = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.cumsum(size) - size
            own = np.zeros(len(vocab), bool)

            def near(i: int, js: np.ndarray) -> np.ndarray:
                ok = 100 * np.minimum(size[i], size[js]) >= percent * np.maximum(size[i], size[js])  # noqa: B023
                js = js[ok]
                if len(js):
                    mine = flat[start[i] : start[i] + size[i]]  # noqa: B023
                    own[mine] = True  # noqa: B023
                    lens = size[js]  # noqa: B023
                    first = np.cumsum(lens) - lens
                    at = np.repeat(start[js] - first, lens) + np.arange(int(lens.sum()))  # noqa: B023
                    shared = np.add.reduceat(own[flat[at]].astype(np.int64), first)  # noqa: B023
                    own[mine] = False  # noqa: B023
                    ok[ok] = 100 * shared >= percent * (size[i] + lens - shared)  # noqa: B023
                return ok

            for x, y in _spanning(near, hi - lo):
                a.append(ids[lo + x])
                b.append(ids[lo + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _greatest(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The keys of each group and the greatest count of every bin; without bins if a member has none."""
    for batch, cut in whole_groups(batches, keys):
        rows = batch.column("bins").to_pylist()
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = [np.frombuffer(x, np.uint8) for x in rows[lo:hi]]
            out.append(np.maximum.reduce(own).tobytes() if min(map(len, own)) else b"")
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(cut[:-1])) for k in keys], pa.array(out, pa.binary())], names=[*keys, "bins"])


def _group_bins(alike: DataFrame, block: int) -> DataFrame:
    """grp and bins of every group of several classes; large ones are put together from parts."""
    parts = alike.select("grp", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / block)).alias("part"), "bins")
    for keys in (["grp", "part"], ["grp"]):
        schema = ", ".join([*[f"{k} long" for k in keys], "bins binary"])
        parts = parts.select(*keys, "bins").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b, keys=keys: _greatest(b, keys), schema)
    return parts


def _blocks(df: DataFrame, key: str, count: str, member: str, block: int) -> DataFrame:
    """Adds i and j, the pair of blocks that a row takes part in; one pair for a key whose count is up to `block`."""
    shards = F.ceil(F.col(count) / block).cast("int")
    mine = F.pmod(F.xxhash64(member), F.greatest(shards, F.lit(1))).cast("int")
    df = df.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.greatest(shards, F.lit(1)) - 1)))
    return df.withColumn("i", F.least("_mine", "_other")).withColumn("j", F.greatest("_mine", "_other")).drop("_mine", "_other")


def link(docs: DataFrame, text: str = "text", size: int = 3, percent: int = 90, hot_share: int = HOT_SHARE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over similar pairs) of every row; similar: 100 * overlap >= percent * union."""
    own = plain(docs, text)
    known = written(classes(own, size, percent), "classes")
    reps = written(known.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")), "reps")
    hot = frequent(known, reps.count(), hot_share)

    # one profile for each class, from its first document
    full = profiles(own.where("doc_id IS NOT NULL"), hot, size, percent).join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "key"], "left_semi")
    full = written(full.drop("key"), "profiles")
    # one group for equal prefixes and sizes; its bins bound the overlap of any of its members
    groups = full.groupBy("n", "prefix").agg(F.min("doc_id").alias("grp"), F.count(F.lit(1)).alias("members"), F.first("bins").alias("bins"))
    groups = written(groups.withColumn("bins", F.when(F.col("members") == 1, F.col("bins"))), "groups")
    alike = full.join(groups.where("members > 1").select("n", "prefix", "grp", "members"), ["n", "prefix"])
    alike = written(alike.select("grp", "doc_id", "members", "bins"), "alike")
    shapes = groups.select("grp", "n", F.col("bins").alias("_own")).join(_group_bins(alike, block), "grp", "left")
    shapes = shapes.select("grp", "n", F.coalesce("_own", "bins").alias("bins"))
    alike = alike.select(F.col("grp").alias("a"), F.col("doc_id").alias("b"))

    tokens = groups.select("grp", F.posexplode("prefix").alias("at", "token"))
    recurring = written(tokens.groupBy("token").count().where("count > 1"), "postings")
    posts = tokens.join(recurring, "token").join(shapes, "grp")
    posts = _blocks(posts, "token", "count", "grp", block).select("token", "i", "j", "grp", F.col("at").cast("long").alias("at"), "n", "bins")
    posts = posts.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = posts.mapInArrow(lambda b: _candidates(b, percent), "a long, b long")
    cluster = components(found.unionByName(alike))
    cluster = cluster.unionByName(cluster.select(F.col("component").alias("node"), "component").distinct())
    cluster = written(cluster.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")

    cluster = cluster.join(full.select("doc_id", F.col("n").alias("shingles")), "doc_id")
    sizes = cluster.groupBy("cluster").agg(F.sum("shingles").alias("total"))
    member = cluster.select("doc_id", "cluster").join(sizes, "cluster")
    inside = own.join(member.hint("shuffle_hash"), "doc_id")

    def work(part: pa.RecordBatch) -> list:
        sets = [s.tobytes() for s in _sets(part.column(1), size)]
        return [part.column(0), part.column(2), part.column(3), pa.array(sets, pa.binary())]

    sets = _map(inside.select("doc_id", "text", "cluster", "total"), "doc_id long, cluster long, total long, shingles binary", work)
    sets = _blocks(sets, "cluster", "total", "doc_id", block_shingles).select("cluster", "i", "j", "doc_id", "shingles")
    sets = sets.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = components(sets.mapInArrow(lambda b: _verified(b, percent), "a long, b long"))

    out = known.drop("first").join(reps, "key", "left").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
