import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

INSULTS = ["idiot", "moron", "worthless"]


def build(spark, docs, save, n=400):
    random.seed(11)
    vocab = ["".join(random.choice("bdfgklmnprst") + random.choice("aeiou") for _ in range(random.randint(1, 3))) for _ in range(900)]
    line = lambda k: " ".join(random.choice(vocab) for _ in range(k))
    item = line(30)
    texts, toxic = [], set()
    for i in range(n):
        t = line(random.randint(40, 90)) + "."
        if i % 6 == 0:
            t += " You " + " ".join(random.choice(INSULTS) for _ in range(3)) + "."
            toxic.add(i)
        texts.append(t)
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(n)], "doc_id long, quality int, toxic int")
    texts += [texts[1], texts[1].replace(" ", "\n", 1), texts[2] + " end", "before " + item + " after", "mail me at a.b@c.de or +1 (017) 555-7713", "", None]
    df = docs(texts)
    where = save(documents=df, labels=labels, benchmark=spark.createDataFrame([(0, item)], "item_id long, text string"))
    return where, texts, toxic, n


def test_stages(spark, docs, save):
    where, texts, toxic, n = build(spark, docs, save)
    kept = spark.read.parquet(f"{where}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.written(stage(spark, kept, where), "test")
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
        if name == "personal_data":
            assert kept.where(f"doc_id = {n + 4}").first().text == "mail me at <email> or <phone>"
        if name != "encoding":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
    first, second, third, fourth, last = seen
    assert len(toxic & first) <= 2 and len(set(range(len(texts))) - toxic - first) <= 2
    assert not {n, n + 1, n + 2} & second and {1, n + 4, n + 5, n + 6} <= second and len(first - second) == 3
    assert second - third == {n + 3}
    assert third == fourth == last
    assert kept.where("NOT round_trip").count() == 0 and kept.where("size(ids) <> n_tokens").count() == 0


def test_run_and_empty(spark, docs, save):
    where, *_ = build(spark, docs, save, 60)
    assert corpus_pipeline.run(spark, where).where(F.col("doc_id").isNotNull()).count() > 0
    save(documents=docs([]))
    assert corpus_pipeline.run(spark, where).count() == 0
