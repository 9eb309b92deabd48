import hashlib
import random

import pyarrow as pa
import pytest

pytest.importorskip("ahocorasick")

from barloom.llm import phrases, queries  # noqa: E402


def brute(rows, window=13):
    first = {}
    cut = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, cut):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, cut):
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < d for p in range(k, k + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed=2, n=160, small=False):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(12 if small else 900)] + ["é", "\x00", "🙂"]
    line = lambda k: [random.choice(vocab) for _ in range(k)]
    shared = [line(random.choice([12, 13, 14, 20, 60])) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(random.randint(0, 5)):
            parts += random.choice(shared) if random.random() < 0.5 else line(random.randint(0, 30))
        texts.append("".join(w + random.choice([" ", "\n", " \t "]) for w in parts))
    texts += [" ".join(shared[-1] * 4)] * 3 + ["", None, " ", "a " * 300, "a " * 200]
    return texts


@pytest.mark.parametrize("limit", [2000, 3])
@pytest.mark.parametrize("small", [False, True])
def test_same_as_brute_force(docs, limit, small):
    texts = corpus(small=small, n=120)
    ids = random.sample(range(10_000), len(texts))
    got = phrases.digest(phrases.remove_repeats(docs(texts, ids, extra=True), limit=limit))
    assert sorted(tuple(r) for r in got.collect()) == brute(list(zip(ids, texts)))


def busy(n=60, places=30):
    """Texts that all hold one seed in many places, among words of their own and some that they share."""
    random.seed(9)
    fresh = (f"f{i}" for i in range(10**9))
    shared = [[f"s{i}-{k}" for k in range(20)] for i in range(5)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(places):
            words += ["to", "be", "or", "not"] + (random.choice(shared) if random.random() < 0.1 else [next(fresh) for _ in range(random.randint(5, 14))])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("limit,letters", [(2000, phrases.LETTERS), (100, phrases.LETTERS), (2000, 50)])
def test_a_seed_in_many_places(docs, monkeypatch, limit, letters):
    monkeypatch.setattr(phrases, "LETTERS", letters)
    texts = busy()
    got = phrases.digest(phrases.remove_repeats(docs(texts), limit=limit))
    assert sorted(tuple(r) for r in got.collect()) == brute(list(enumerate(texts)))


def test_more_words_than_letters():
    rows = [(0, -1, i % 2, 0, 0, " ".join([*(f"{i}-{k}" for k in range(600_000)), *(f"c{k}" for k in range(13))]).encode()) for i in range(2)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("h", "salt", "doc_id", "fp", "at", "body"), r)) for r in rows])
    shard = phrases.Shard(batch, 13)
    assert shard.width == 2
    assert {tuple(v) for v in shard.locate().values()} == {((600_000, 600_013, 0),)}


def test_long_text(docs):
    random.seed(1)
    words = [f"w{random.randint(0, 3000)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join(["x", *words[100:40_000], "y"]), " ".join(words[-20_000:])]
    got = phrases.digest(phrases.remove_repeats(docs(texts)))
    assert sorted(tuple(r) for r in got.collect()) == brute(list(enumerate(texts)))


def test_repeated_ids_and_null_id(docs, save):
    text = " ".join(f"v{i}" for i in range(40))
    df = docs([text, text, text + " x", "other", text], [5, 5, 5, 6, 7])
    df = df.unionByName(docs([text], [None]))
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in queries.op1_phrases(df.sparkSession, save(documents=df)).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 5, 0), (False, 6, 0), (False, 7, 40), (True, None, 0)]


def test_empty_table(docs, save):
    assert queries.op1_phrases(docs([]).sparkSession, save(documents=docs([]))).count() == 0
