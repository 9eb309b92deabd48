import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Words that names of intermediate columns might take; documents may carry such columns.
CLASHES = ("word", "h", "hash", "n", "n_words", "start", "pos", "component_id", "count", "block")


@pytest.fixture
def docs(spark):
    """Builds a documents table of texts, with ids from 0 on and clashing extra columns if asked."""
    from pyspark.sql import functions as F

    def build(texts, ids=None, extra=False):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
        df = spark.createDataFrame(rows, DOCS)
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df

    return build


@pytest.fixture
def save(tmp_path):
    """Writes tables into a folder that queries can be given."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put
