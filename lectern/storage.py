"""The folder that all executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_by(df: DataFrame, name: str, files: int, key: str = "doc_id") -> str:
    """The name of a table of the session's catalog: ``df`` written once, in this many files by a hash of the key."""
    path = new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(files, key).option("path", path).saveAsTable(table)
    return table


#: Rows up to which a side of a join is handed to every task.
SMALL = 10_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most ``SMALL`` rows; else Spark joins it as it finds best."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


@contextmanager
def by_documents(spark: SparkSession) -> Iterator[None]:
    """While plans run: two tables that both lie by documents are joined on a document and more without a shuffle, and
    steps whose fused code would be longer than the JVM compiles (8000 bytes a method) are not fused. No side of a join is
    handed to every task by its size: what is known of a stored table's size is that of its compressed files.
    """
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.codegen.hugeMethodLimit": "8000"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def views(frames: dict[str, DataFrame]) -> Iterator[None]:
    """Temporary views of these frames while SQL over them is planned; the session's own views of such names come back after."""
    if not frames:
        yield
        return
    spark = next(iter(frames.values())).sparkSession
    taken = {v.viewName for v in spark.sql("SHOW VIEWS").filter("isTemporary").collect()} & set(frames)
    before = {name: spark.table(name) for name in taken}
    try:
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        yield
    finally:
        for name in frames:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
