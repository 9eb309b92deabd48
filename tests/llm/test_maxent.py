import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import maxent, queries


def corpus(n=300, seed=6):
    """Sentences of two made-up languages, so that contexts tell something."""
    random.seed(seed)
    langs = [[f"{a}{b}" for a in p for b in q] for p, q in ((("ka", "ko", "ku", "ke"), ("la", "lo", "lu", "li", "le")), (("ta", "to", "tu"), ("sa", "so", "su", "si", "se", "sy")))]
    out = []
    for _ in range(n):
        words = random.choice(langs)
        out.append(" ".join(random.choice(words).title() if random.random() < 0.1 else random.choice(words) for _ in range(random.randint(0, 60))))
    return [*out, None, "", " \n", "zzz unheard-of", "é 🙂 \x00", "a " * 20_000]


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def test_query(docs, save):
    texts = corpus()
    rows = {r.doc_id: r for r in queries.op2_maxent(docs(texts).sparkSession, save(documents=docs(texts, extra=True))).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    c = Counter(x for i, t in enumerate(texts) if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        own = tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(c[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), rel_tol=1e-9)
        assert r.score < 0
    out = [r for i, r in rows.items() if held[i] and i < 300]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)


def test_probabilities_sum_to_one(docs):
    df = docs(corpus(60)).select(F.coalesce("text", F.lit("")).alias("text"))
    known = maxent.counts(df)
    model = maxent.train(df, maxent.start(known), rounds=1)
    rows = known.collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    c = np.array([r["c"] for r in rows])
    for context in ("", "kala", "kala kolo", "tosa"):
        t = maxent.Tokens(pa.array([context]))
        total = 0.0
        for hash_, tail, count in [*zip(h, (r["tail"] for r in rows), c), *((np.uint64(12345 + k), k, 0) for k in range(maxent.TAILS))]:
            t.hash[-1], t.tail[-1] = hash_, tail
            total += math.exp(model.log_probability(t, np.append(np.zeros(len(t.hash) - 1), count))[-1])
        assert abs(total - 1) < 1e-4


def test_several_tasks_are_averaged_in_levels(docs):
    """Nine tasks, summed in one level or in four, give the same weights; and they tell more than no weights."""
    df = docs(corpus(900)).select(F.coalesce("text", F.lit("")).alias("text")).repartition(9, "text")
    first = maxent.start(maxent.counts(df))
    n = df.agg(F.sum(F.length("text"))).first()[0]
    flat, deep = (maxent.train(df, first, rounds=1, tokens=n, task_tokens=-(-n // 9), fan=k) for k in (32, 2))
    assert np.abs(flat.class_rows).max() > 0.05
    assert np.abs(flat.class_rows - deep.class_rows).max() < 0.01 and np.abs(flat.member_rows - deep.member_rows).max() < 0.01
    t = maxent.Tokens(pa.array([x or "" for x in corpus(100, seed=7)]))
    none = np.zeros(len(t.hash))
    assert flat.log_probability(t, none).sum() > first.log_probability(t, none).sum()


def test_edges(spark, docs):
    df = docs(["a b", "a b", None], [5, 5, None])
    got = maxent.score(df, F.lit(None).cast("boolean")).collect()
    assert len(got) == 3 and not any(r.held_out for r in got)
    none = maxent.score(df, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 for r in none)
    assert maxent.score(docs([]), F.lit(False)).count() == 0
