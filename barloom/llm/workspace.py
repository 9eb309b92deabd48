"""Tables written between the steps of an operator, in the folder that the cluster shares.

A step that is read more than once, or that ends a round of an iteration, is written as Parquet and
reread: its lineage is cut, and a lost executor costs no more than the step at hand.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset in local mode, as in tests, a temporary folder.

    On a cluster without the setting it raises ValueError: executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    if given := sc.getConf().get("spark.checkpoint.dir", None):
        return given
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB, unless the session asks for another size than Spark's own 64 MB.

    A task holds a batch several times over, in the JVM and in Python, besides the slice it works on.
    """
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """As written(), with a function that deletes the table, for when a later one has taken its place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def discard() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), discard
