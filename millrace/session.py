"""Session helpers: a local session for tests, and the shared folder for scratch and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Spark 4.1 may plan a join on a union's partitions and, once adaptive execution has changed its inputs, run the union
#: without them: "Can't zip RDDs with unequal numbers of partitions". Off, such a union is shuffled by the join's keys.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def local_session(scratch: str, cores: int | str = 8, memory: str = "8g", app: str = "millrace") -> SparkSession:
    """A session of one machine for tests and the bench, with the folder that its scratch goes to. On a cluster the caller
    brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.checkpoint.dir", scratch)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config(UNION_PARTITIONING, "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one that the cluster names, else one beside its tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, path: str | None = None) -> DataFrame:
    """Pin a frame's rows as Parquet in the shared folder (or at a path there), so that two readers of it
    always see the same rows even when an executor is lost in between. The planner then also knows its
    size, and broadcasts it to joins only if it is small."""
    path = path or scratch_path(df.sparkSession, "frozen")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: Sequence[Mapping], schema: StructType | str) -> DataFrame:
    """A few rows that the driver holds, as a frame that needs neither a task nor generated code to be read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    plain = [{f.name: list(v.items()) if isinstance(v := r.get(f.name), Mapping) else v for f in fields} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(plain, to_arrow_schema(fields)), fields)


@contextmanager
def scratch_dir(spark: SparkSession, label: str = "scratch"):
    """A fresh folder in the shared one that goes when the block ends: for what `freeze` and `numbered` write."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        fs, jpath = hadoop_path(spark, path)
        fs.delete(jpath, True)


@contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Set SQL confs (dots written as double underscores) and restore them afterwards."""
    names = {key.replace("__", "."): value for key, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) for driver-side directory questions that read no data."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath
