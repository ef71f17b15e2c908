"""Session helper with the settings the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ledgerwell", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; an existing session is reused."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


#: Bytes of files below which a table is dealt out.
SMALL = 16 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores: a file of one row group is read by one task, which would do all the work on its rows.
    Larger tables are left as their files deal them."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the folder that all executors share (spark.checkpoint.dir), deleted when the session's process ends.

    A folder of our own is made only where none is set, on a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: built once, read by every query."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
