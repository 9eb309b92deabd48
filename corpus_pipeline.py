"""Corpus pipeline: each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns a DataFrame; run() writes every result as Parquet and rereads it as the next stage's docs.

The stages read the labels and the benchmark of `sf_dir`; documents come from the stage before. All but
the last return the columns of documents. A row with a null doc_id passes the stages that decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, jaccard, pii, templates, toxicity
from barloom.llm.queries import fold
from barloom.llm.workspace import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.5; learns from the labels of documents outside fold 0."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0))
    return toxicity.score(docs, model, keep=("text", "lang", "source", "n_chars")).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents (five-word shingles, similarity of 0.8 or more) the one of least doc_id.

    Documents without words are no one's duplicates. Rows that repeat a kept id stay with it.
    """
    linked = jaccard.link(docs, size=5, percent=80)
    gone = written(linked.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, not even with other numbers, names or units."""
    found = templates.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(found.select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; personal data in its text is replaced by the kind of data, and n_chars follows."""
    found = pii.detect(docs, keep=("text", "lang", "source", "n_chars"))
    masked = found.withColumn("_masked", pii.mask(found))
    n = F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("_masked").cast("long"))
    return masked.select("doc_id", F.col("_masked").alias("text"), "lang", "source", n.alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the ids decode to the text, of every document."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True, keep=("lang", "source"))
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("encoding", encode),
]

#: Trained scores and gapped templates are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
