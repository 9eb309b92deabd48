"""The registered queries of the text operators: opN_<name>(spark, sf_dir), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, heap_lloyd, html_cut, jaccard, langid, maxent, oracles, phrases, pii, quality, suffixes, templates, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.remove_repeats(table(spark, sf_dir, "documents")))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), fold() == 1)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold() != 0))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return bpe.digest(coded)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op10_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_cut.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.digest(*heap_lloyd.compress(table(spark, sf_dir, "embeddings")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(langid.fold() != 2)))
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_phrases": op1_phrases, "op2_maxent": op2_maxent, "op3_suffixes": op3_suffixes, "op4_toxicity": op4_toxicity, "op5_bpe": op5_bpe, "op6_quality": op6_quality, "op7_templates": op7_templates, "op8_jaccard": op8_jaccard, "op9_pii": op9_pii, "op10_html_cut": op10_html_cut, "op11_heap_lloyd": op11_heap_lloyd, "op12_collocations": op12_collocations, "op13_langid": op13_langid}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
