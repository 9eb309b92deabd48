import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import collocations, queries

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def pieces(text):
    for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
        if w := re.findall(r"[^\x20\x09]+", p):
            yield w


def brute(rows, least=100, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "Étoile", "\x00", "x\xa0y", "zwölf", "a", "b", "a", "ÉTOILE"] + [f"w{i}" for i in range(30)]
    stock = ["New York city", "of the a b a", "a a a a a a", "zwölf zwölf Étoile", "one two three four five six"]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(1, 12)):
            t.append(rng.choice(stock) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 9))))
            t.append(rng.choice([". ", " ", ",", "\n", "\t", "  ", "\r\n", "! "]))
        out.append("".join(t))
    return out


def table(docs, rows):
    df = docs([t for t, _ in rows], extra=True)
    langs = df.sparkSession.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, l string")
    return df.join(langs, "doc_id").withColumn("lang", F.col("l")).drop("l").repartition(3)


ODD = [(None, "en"), ("", "fr"), (" \t", None), (None, None), (".,;:!?", "en"), ("a b", "fr")]


@pytest.mark.parametrize("shard", [1 << 20, 64])
def test_query(docs, save, shard, monkeypatch):
    rng = random.Random(4)
    rows = [(t, rng.choice(["en", "en", "fr", None])) for t in texts(1200)] + ODD
    rows += [(rows[0][0], "en")] * 90 + [("long tail of words " * 30_000, "xx"), ("one two " * 60 + "three", "xx")]
    monkeypatch.setattr(collocations, "SHARD", shard)
    df = table(docs, rows)
    got = sorted(map(tuple, queries.op12_collocations(df.sparkSession, save(documents=df)).collect()))
    assert got == brute(rows) and len(got) > 40


def test_top_and_least(docs):
    rows = [(t, "en") for t in texts(60, 7)]
    got = sorted(map(tuple, collocations.mine(table(docs, rows), least=5, top=17).collect()))
    assert got == brute(rows, 5, 17) and len(got) == 17


@pytest.mark.parametrize("rows", [[], ODD])
def test_nothing(docs, rows):
    assert collocations.mine(table(docs, rows)).collect() == []


def test_a_full_bitmap_changes_nothing(docs, monkeypatch):
    """Where every bit is set, as the bitmap of a very large corpus may be, only more rows are counted."""
    rows = [(t, "en") for t in texts(60, 7)]
    monkeypatch.setattr(collocations, "frequent_pairs", lambda own, least: np.full(1 << 13, 255, np.uint8))
    assert sorted(map(tuple, collocations.mine(table(docs, rows), least=5).collect())) == brute(rows, 5)


def test_intervals_count_every_phrase():
    own = texts(50, 11)
    shard = collocations.Shard(pa.array(["en"] * len(own)), pa.array(own))
    got = Counter()
    for n, places, counts in shard.phrases(np.full(1 << 13, 255, np.uint8)):
        got.update(dict(zip(shard.texts(places, n).to_pylist(), counts.tolist())))
    want = Counter(" ".join(w[i : i + k]) for t in own for w in pieces(t) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert got == want
