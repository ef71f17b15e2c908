"""Shared pieces: the written intermediate tables and the word definition."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The unsigned CRC-32 of the bytes in a list, bit by bit.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

_scopes: list[str] = []
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where it is unset, on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="ledgerwell-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted with its scope, or at the latest when the session's process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    if _scopes:
        _written.setdefault(_scopes[-1], []).append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def forget(spark: SparkSession, scope: str) -> None:
    """Deletes the tables written under a scope whose readers are done."""
    for path in _written.pop(scope, []):
        delete(spark, path)


@contextlib.contextmanager
def scope(name: str):
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def words(text: Column) -> Column:
    """The words of a text as an array; none for null or blank text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """The number of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_numbers(docs: DataFrame, tag: str) -> DataFrame:
    """docs, written, with row: a number for each row, rising with doc_id (null last) and a hash of the text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = docs.select("*", *(c.alias(f"_k{k}") for k, c in enumerate(order)))
    names = [f"_k{k}" for k in range(len(order))]
    dealt = keyed.repartitionByRange(parts, *names).sortWithinPartitions(*names).withColumn("row", F.monotonically_increasing_id())
    return written(dealt.drop(*names), tag)


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row inside a larger expression."""
    return F.transform(F.array(value), body)[0]


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


#: Tasks over which spread_join deals the rows of one key.
SPREAD = 16


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, how: str = "inner", lone: str | None = None) -> DataFrame:
    """rows joined with per_key (one row a key), whose rows are repeated so that those of a hot key are dealt over SPREAD tasks
    by the column `by`. lone: a column of per_key with the `by` of a key's only row, null for keys of several; those aren't repeated."""
    every = F.sequence(F.lit(0), F.lit(SPREAD - 1))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SPREAD)).cast("int")
    parts = every if lone is None else F.when(F.col(lone).isNull(), every).otherwise(F.array(part(lone)))
    dealt = per_key.withColumn("_part", F.explode(parts))
    return rows.withColumn("_part", part(by)).join(dealt.drop(lone) if lone else dealt, [key, "_part"], how).drop("_part")
