import random

import numpy as np

from barloom.llm import queries, toxicity

INSULTS = ["idiot", "moron", "worthless", "trash"]


def corpus(n=900, seed=7):
    random.seed(seed)
    vocab = ["".join(random.choice("aeiou") + random.choice("bcdfglmnprst") for _ in range(random.randint(1, 4))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = [random.choice(vocab) for _ in range(random.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(random.randint(0, len(words)), random.choice(INSULTS))
        rows.append((" ".join(words) + ".", int(toxic)))
    return rows


def tables(spark, docs):
    rows = corpus()
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    return docs([t for t, _ in rows]), labels, rows


def test_kernel_tolerates_gaps():
    marks = toxicity.Landmarks(["idiot"])
    same, gap, other = marks.similar(["idiot", "idxiot", "table"])[:, 0]
    assert abs(same - 1) < 1e-5 and gap > 0.5 and other < 0.2
    assert "idiot" in toxicity.tokens("you I d-i o T now") and "idiot" in toxicity.tokens("an i.d.i-o*t")
    assert np.allclose(marks.similar(["", "a", "ab"]), 0)


def exact(a, b):
    """The cosine of the gap-weighted subsequences of three characters, counted one by one."""

    def vector(w):
        w, out = f"\x02{w}\x02", {}
        for i in range(len(w)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(w))):
                for j in range(i + 1, k):
                    key = w[i], w[j], w[k]
                    out.setdefault(key, []).append(toxicity.DECAY ** (k - i + 1))
        return out

    x, y = vector(a), {k: sum(v) for k, v in vector(b).items()}
    length = sum(v * v for own in x.values() for v in own) ** 0.5 * sum(v * v for v in y.values()) ** 0.5
    return min(1, sum(sum(own) * y.get(k, 0) for k, own in x.items()) / length) if length else 0


def test_kernel_against_every_subsequence():
    random.seed(3)
    words = ["".join(random.choice("abcé") for _ in range(random.randint(1, 12))) for _ in range(150)] + ["x" * 300]
    marks = toxicity.Landmarks(words[:20])
    got = marks.similar(words)
    want = np.array([[exact(w, m) for m in words[:20]] for w in words])
    want[want < toxicity.FLOOR] = 0
    assert np.abs(np.where(np.abs(want - toxicity.FLOOR) < 1e-3, 0, got - want)).max() < 1e-3
    # the bound leaves no similar word out, and a text's bag holds them all in their places
    texts = [" ".join(words[i : i + 9]) + (". " if i % 2 else "\n") for i in range(0, 150, 9)] + ["", "no  such-thing"]
    bag = marks.bags(texts)
    flat = [w for t in texts for w in t.replace(".", " ").split()]
    some = [i for i, w in enumerate(flat) if marks.similar([w]).any()]
    assert len(bag.sims) == len(some) and np.allclose(bag.sims, marks.similar([flat[i] for i in some]))
    assert bag.count.tolist() == [len(t.replace(".", " ").replace("-", " ").split()) for t in texts]


def test_ties_and_repeats(spark, docs):
    rows = [("bad fool here", 1), ("a fool bad there", 1), ("fine day", 0), ("good day", 0), ("long day", 0)] * 40
    df = docs([t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    first, again = (toxicity.train(df, labels) for _ in range(2))
    assert first.landmarks == again.landmarks == tuple(sorted(first.landmarks)) and np.allclose(first.weights, again.weights)
    scores = toxicity.score(df, first).groupBy("doc_id").count().where("count > 1")
    got = {}
    for r in toxicity.score(df, first).collect():
        got.setdefault(rows[r.doc_id][0], set()).add((r.score, r.predicted))
    assert scores.count() == 0 and all(len(v) == 1 for v in got.values())
    assert {t: next(iter(v))[1] for t, v in got.items()} == {t: y for t, y in rows}


def test_learns_and_finds_variants(spark, docs):
    df, labels, rows = tables(spark, docs)
    model = toxicity.train(df, labels.where("doc_id % 3 != 0"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(len(rows)) if i % 3 == 0]
    assert sum(got[i].predicted == rows[i][1] for i in held) > 0.97 * len(held)
    odd = docs(["a plain line of the text", "you are an idxiot and it is so", "an i d i o t here", None, "", "x" * 50_000, "the idiot " * 5000], extra=True)
    p = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(p) == 7 and all(0 <= x <= 1 for x in p.values())
    assert p[1] > p[0] and p[2] >= 0.5 and p[6] >= 0.5 and p[3] == p[4] < 0.5


def test_query(spark, docs, save):
    df, labels, rows = tables(spark, docs)
    where = save(documents=df, labels=labels)
    got = queries.op4_toxicity(spark, where).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_nothing_to_learn(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        model = toxicity.train(docs(["a b", None]), own)
        assert [r.predicted for r in toxicity.score(docs(["a b", None]), model).collect()] == [0, 0]
    assert toxicity.score(docs([]), model).count() == 0
