"""Result tables of runs: several tables that become visible together.

Layout below a base folder: <table>/run_id=<id>/attempt=<attempt>/, and _manifest/run_id=<id>/ with one row for each table
of the attempt that counts. A run's tables are written first and its manifest last, so that readers, who
go by the manifest, see a whole run or none of it. A later run of the same id is another attempt: until
its manifest replaces the old one (dynamic partition overwrite), readers stay with the old attempt.
Everything lies in the store that the session's paths name; nothing is collected but names and counts.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN, ATTEMPT = "run_id", "attempt"
MANIFEST = "_manifest"
MANIFEST_SCHEMA = "run_id string, attempt string, committed_at timestamp, table_name string, n_rows bigint, columns string"


def _name(text: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*(_[A-Za-z0-9.-]+)*", text):
        raise ValueError(f"not a name for a run or table: {text!r}")
    return text


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Run:
    """Writes the tables of a run; with `with`, commits if the block ends without an error.

    with Run(spark, base, "2024-momentum") as run:
        signals = run.put("signals", ...)   # reread: later tables start from what is written
        run.put("ic", ic_frame(signals, "predict"))
    """

    def __init__(self, spark: SparkSession, base: str, run_id: str):
        self.spark, self.base, self.run_id = spark, base.rstrip("/"), _name(run_id)
        self.attempt = uuid.uuid4().hex
        self.tables: dict[str, DataFrame] = {}
        self.passing: list[str] = []
        self.committed = False

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Writes a table of the run and returns it as written; ValueError for a name twice or a column of the layout's."""
        if self.committed or _name(table) in self.tables:
            raise ValueError(f"{table}: the run is committed" if self.committed else f"{table} is written already")
        if clash := {RUN, ATTEMPT} & {c.lower() for c in df.columns}:
            raise ValueError(f"{table} has columns that the layout needs: {sorted(clash)}")
        self.tables[table] = self._written(table, df)
        return self.tables[table]

    def aside(self, table: str, df: DataFrame) -> DataFrame:
        """Writes rows that several tables of the run start from and returns them as written; no table of the run, they go as the block ends."""
        out = self._written(f"_{_name(table)}", df)
        self.passing.append(self._path(f"_{table}"))
        return out

    def _path(self, table: str) -> str:
        return f"{self.base}/{table}/{RUN}={self.run_id}/{ATTEMPT}={self.attempt}"

    def _written(self, table: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self._path(table))
        return self.spark.read.schema(df.schema).parquet(self._path(table))

    def commit(self) -> None:
        """Writes the manifest: from now on readers see this attempt in place of any earlier one of the run."""
        # counts come from the footers of what was written
        rows = [(self.run_id, self.attempt, name, df.count(), df.schema.json()) for name, df in self.tables.items()]
        found = self.spark.createDataFrame(rows, "run_id string, attempt string, table_name string, n_rows bigint, columns string").withColumn("committed_at", F.current_timestamp())
        found = found.select(*[f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]).coalesce(1)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(f"{self.base}/{MANIFEST}")
        self.committed = True

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()
        for path in self.passing:
            _delete(self.spark, path)


def runs(spark: SparkSession, base: str) -> DataFrame:
    """The manifest: one row for each table of each complete run."""
    path = f"{base.rstrip('/')}/{MANIFEST}"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def read_results(spark: SparkSession, base: str, table: str, run_ids: list[str] | None = None) -> DataFrame:
    """run_id and the columns of a table, over all complete runs or some.

    Runs whose table has other columns fill up with nulls; ValueError where a column has two types, or if no complete
    run has the table. Only the folders of the attempts that count are listed and read.
    """
    own = runs(spark, base).where(F.col("table_name") == table)
    if run_ids is not None:
        own = own.where(F.col(RUN).isin(list(run_ids)))
    found = own.select(RUN, ATTEMPT, "columns").collect()
    if not found:
        raise ValueError(f"no complete run has a table {table}")
    fields: dict[str, T.StructField] = {}
    for r in found:
        for f in T.StructType.fromJson(json.loads(r["columns"])).fields:
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"{table}.{f.name} is {fields[f.name].dataType.simpleString()} in one run and {f.dataType.simpleString()} in another")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()] + [T.StructField(RUN, T.StringType()), T.StructField(ATTEMPT, T.StringType())])
    root = f"{base.rstrip('/')}/{table}"
    paths = [f"{root}/{RUN}={r[RUN]}/{ATTEMPT}={r[ATTEMPT]}" for r in found]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).select(RUN, *fields)


def drop_run(spark: SparkSession, base: str, run_id: str) -> None:
    """Makes a run unseen, then deletes its tables."""
    tables = [r["table_name"] for r in runs(spark, base).where(F.col(RUN) == _name(run_id)).select("table_name").collect()]
    _delete(spark, f"{base.rstrip('/')}/{MANIFEST}/{RUN}={run_id}")
    for t in tables:
        _delete(spark, f"{base.rstrip('/')}/{t}/{RUN}={run_id}")


def vacuum(spark: SparkSession, base: str, run_id: str) -> int:
    """Deletes the attempts of a run that no manifest names: replaced ones, and those that broke off. Returns how many folders went.

    Not while the run is being written.
    """
    base = base.rstrip("/")
    counts = {(r["table_name"], r[ATTEMPT]) for r in runs(spark, base).where(F.col(RUN) == _name(run_id)).select("table_name", ATTEMPT).collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/*/{RUN}={run_id}/{ATTEMPT}=*")) or []:
        at = status.getPath()
        if (at.getParent().getParent().getName(), at.getName().partition("=")[2]) not in counts:
            store.delete(at, True)
            gone += 1
    return gone
