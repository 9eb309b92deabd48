import hashlib
import math
import random

import numpy as np
import pytest

from barloom.llm import heap_lloyd, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int"


def brute(rows, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: r[:2])
    d = len(kept[0][1]) // 8
    cut = [[v[p * d : (p + 1) * d] for _, v, _ in kept] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in cut]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))

    def assign():
        return [[min(range(len(b)), key=lambda j: (far(x, b[j]), j)) for x in own] for own, b in zip(cut, books)]

    for _ in range(rounds):
        for p, own in enumerate(assign()):
            for j in range(len(books[p])):
                mine = [x for x, a in zip(cut[p], own) if a == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = assign()
    out = []
    for k, (i, _, y) in enumerate(kept):
        out.append((i, "".join(f"{last[p][k]:02x}" for p in range(8)), sum(far(cut[p][k], books[p][last[p][k]]) for p in range(8)), y))
    sums = {}
    for _, _, e, y in out:
        sums[y] = sums.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, c, e, sums[y], sha) for i, c, e, y in out)


def rows_of(kind, n=300, dim=16, seed=1):
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    value = {"normal": lambda: [rng.gauss(0, 0.2) for _ in range(dim)], "clusters": lambda: [c + rng.gauss(0, 0.02) for c in rng.choice(centre)],
             "ties": lambda: [rng.randint(-2, 2) / 4096 for _ in range(dim)], "same": lambda: [0.25] * dim, "large": lambda: [rng.gauss(0, 3e4) for _ in range(dim)]}[kind]
    return [(i * 3 % n if n % 3 else i, value(), rng.choice([None, 0, 1, 1, 1])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["normal", "clusters", "ties", "same", "large"])
def test_query(spark, save, kind):
    rows = rows_of(kind, 301)
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] * 16, 0), (903, [float("inf")] + [0.0] * 15, None), (904, rows[0][1], None), (905, rows[0][1], 0)]
    df = frame(spark, rows)
    got = queries.op11_heap_lloyd(spark, save(embeddings=df.repartition(3)))
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17])
def test_few_vectors(spark, n):
    rows = rows_of("normal", n)
    assert sorted(map(tuple, heap_lloyd.digest(*heap_lloyd.compress(frame(spark, rows))).collect())) == brute(rows)


def test_nothing_and_lengths(spark):
    assert heap_lloyd.digest(*heap_lloyd.compress(frame(spark, []))).collect() == []
    assert heap_lloyd.digest(*heap_lloyd.compress(frame(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 9, 1)]))).count() == 0
    rows = rows_of("normal", 40)
    odd = [(100, [0.5] * 8, 1), (101, [0.5] * 15, None)]
    assert sorted(map(tuple, heap_lloyd.digest(*heap_lloyd.compress(frame(spark, rows + odd))).collect())) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = rows_of("normal", 50)
    twice = [*rows, *rows[:7], (None, [0.1] * 16, 2)]
    got = heap_lloyd.digest(*heap_lloyd.compress(frame(spark, twice))).collect()
    assert len(got) == 58 and sum(r.vec_id is None for r in got) == 1
    again = heap_lloyd.digest(*heap_lloyd.compress(frame(spark, twice[::-1]).repartition(5))).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}


@pytest.mark.parametrize("size", [1 << 10, 1 << 27, 1 << 45])
def test_distances_are_exact(size):
    rng = random.Random(size)
    x, book = ([[rng.randint(-size, size) for _ in range(4)] for _ in range(n)] for n in (20, 5))
    got = heap_lloyd.distances(np.array(x), np.array(book)).tolist()
    assert got == [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in book] for v in x]
    own, _ = heap_lloyd.nearest(np.array(x), np.array(book))
    assert own.tolist() == [d.index(min(d)) for d in got]


def test_few_parts_are_popped():
    """Later rounds look at few parts, and those that stay in their heaps have the nearest entry all the same."""
    x = np.array([[math.floor(4096 * c) for c in v] for _, v, _ in rows_of("clusters", 2000)]).reshape(-1, 8, 2)
    books = np.stack([x[:16, p] for p in range(8)])
    drift = np.zeros((8, 16), np.int64)
    block = heap_lloyd.Block(x, books, None, None)
    block.step(drift)
    looked = []
    real = heap_lloyd.nearest
    for _ in range(6):
        codes = block.codes()
        moved = np.stack([[x[codes[:, p] == j, p].sum(0) // max(1, (codes[:, p] == j).sum()) if (codes[:, p] == j).any() else books[p, j] for j in range(16)] for p in range(8)])
        for p in range(8):
            step = heap_lloyd._fixed((moved[p] - books[p]).tolist())
            drift[p] += [s + max(step[:j] + step[j + 1 :]) for j, s in enumerate(step)]
        books = moved
        data, sizes = block.state()
        block = heap_lloyd.Block(x, books, data, sizes)
        n = 0

        def counted(a, b):
            nonlocal n
            n += len(a)
            return real(a, b)

        heap_lloyd.nearest = counted
        try:
            block.step(drift)
        finally:
            heap_lloyd.nearest = real
        looked.append(n)
        for p in range(8):
            assert (block.codes()[:, p] == real(x[:, p], books[p])[0]).all()
    assert looked[-1] < 2000 * 8 / 4
