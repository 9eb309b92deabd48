import random
import re

import pytest

from barloom.llm import jaccard, queries
from barloom.llm.components import components


def shingles(t, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(ids, texts, percent=90):
    sets = [shingles(t) for t in texts]
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                comp[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, d in enumerate(ids))


def corpus(seed, n=150):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n // 10):
        base = [random.choice(vocab) for _ in range(random.choice([1, 2, 3, 5, 12, 22, 60, 200, 300, 3000]))]
        for _ in range(10):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
                w[random.randrange(len(w))] = random.choice(vocab)
            texts.append(" ".join(w))
    phrase = "this line is in very many of all the documents here"
    texts = [t + "\n" + phrase if random.random() < 0.4 else t for t in texts]
    return [*texts, "", None, " ", "A b C", "a B c", "a b", "A b", "x", "x x", "x x x", "x x x x", *[phrase] * 5]


@pytest.mark.parametrize("seed,block,hot_share", [(1, 4096, 1000), (2, 4, 1000), (3, 4096, 1)])
def test_same_as_brute_force(docs, seed, block, hot_share):
    texts = corpus(seed)
    ids = random.sample(range(10_000), len(texts))
    got = jaccard.link(docs(texts, ids, extra=True), block=block, block_shingles=100 * block, hot_share=hot_share)
    assert sorted(tuple(r) for r in got.collect()) == brute(ids, texts)


def test_frequent_shingles_go_last(docs, monkeypatch):
    import numpy as np

    texts = corpus(5)
    own = jaccard.plain(docs(texts))
    count = {}
    for s in map(shingles, texts):
        for x in s:
            count[x] = count.get(x, 0) + 1
    hashes = np.unique(np.concatenate(jaccard._sets(__import__("pyarrow").array([t or "" for t in texts]), 3)))
    monkeypatch.setattr(jaccard, "frequent", lambda *a: hashes[::3])  # any fixed set is right
    got = jaccard.link(docs(texts))
    assert sorted(tuple(r) for r in got.collect()) == brute(list(range(len(texts))), texts)
    assert own.count() == len(texts)


def test_components(spark):
    random.seed(9)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1050)] + [(None, 5), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {}
    for a, b in edges:
        if a is not None:
            comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {k: v for k, v in comp.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_and_empty(docs, save):
    text = "one two three four five"
    df = docs([text, text, text, None, ""], [4, 4, 9, 5, 6]).unionByName(docs([text], [None]))
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in queries.op8_jaccard(df.sparkSession, save(documents=df)).collect()), key=str)
    assert got == sorted([(False, 4, 3, 4), (False, 4, 3, 4), (False, 9, 3, 4), (False, 5, 0, 5), (False, 6, 0, 6), (True, None, 3, None)], key=str)
    assert queries.op8_jaccard(docs([]).sparkSession, save(documents=docs([]))).count() == 0


def test_group_of_several_classes_has_bins(docs):
    """Bins of a group bound the overlap of every member; without them it would be a candidate of all of its size."""
    import numpy as np

    rows = [(7, 1, 9000, bytes([1, 5, 0])), (7, 2, 9000, bytes([2, 0, 0])), (8, 3, 2, bytes([1, 1, 1])), (8, 4, 2, b"")]
    rows += [(9, 100 + i, 9000, bytes([i % 7, 3, i % 2])) for i in range(50)]
    alike = docs([]).sparkSession.createDataFrame(rows, "grp long, doc_id long, members long, bins binary")
    got = {r.grp: bytes(r.bins) for r in jaccard._group_bins(alike, 100).collect()}
    assert got == {7: bytes([2, 5, 0]), 8: b"", 9: bytes([6, 3, 1])}
    bounds = jaccard._Bounds(np.array([9, 9]), __import__("pyarrow").array([got[7], bytes([0, 4, 5])], "binary"))
    assert bounds.of(np.array([0]), np.array([1])).tolist() == [4]


def test_all_pairs_of_a_posting_keep_their_components():
    import numpy as np

    random.seed(4)
    for m in (2, 3, 6, 40):
        pairs = sorted({tuple(sorted(random.sample(range(m), 2))) for _ in range(m)})
        x, y = np.array(pairs).T
        roots = []
        for a, b in ((x, y), jaccard._forest(x, y, m)):
            root = np.arange(m)
            for _ in range(m):
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
            roots.append(root.tolist())
        assert roots[0] == roots[1]


def test_frequent_does_not_wait_for_larger_tables(docs):
    """A shingle of 300 rows goes last in a table of a million rows as well."""
    known = docs([]).sparkSession.createDataFrame([([1, 2],)] * 300 + [([2, 3],)] * 100, "first array<long>")
    assert jaccard.frequent(known, 1_000_000, jaccard.HOT_SHARE).tolist() == [1, 2]
