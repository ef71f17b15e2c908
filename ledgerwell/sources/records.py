"""Reading and writing of records, alias maps, indexes and vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwell.functions import lists, text
from ledgerwell.operators.chunking import fingerprint
from ledgerwell.operators.dense import encode
from ledgerwell.session import stored

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "category", *lists.RECORD_FIELDS, "source")])
BRANDS = "brand string, generic string, kind string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, all fields as text; an empty or malformed file is an error."""
    raw = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("_bad", T.StringType())])).json(path, multiLine=True, columnNameOfCorruptRecord="_bad")
    raw = stored(raw.select("*"), "records")
    if not raw.where("_bad is not null").isEmpty() or raw.isEmpty():
        raise ValueError(f"{path} holds no list of records")
    return raw.drop("_bad")


def corpus_path(spark: SparkSession, large: str, small: str) -> str:
    """The large file where it is, else the small one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(large)
    return large if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop) else small


def write_records(records: DataFrame, path: str) -> None:
    """Refuses to replace a table by an empty one."""
    if records.isEmpty():
        raise ValueError("nothing to write")
    records.write.mode("overwrite").json(path)


def clean_label(value) -> F.Column:
    """Joined, collapsed and cut text of a list-valued label field."""
    return F.substring(text.collapse(F.array_join(value, " ")), 1, 4000)


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """(brand, generic, kind); a file that can't be read gives no rows, so that nothing is resolved wrongly."""
    try:
        entry = "map<string, struct<generic:string, record:string, reason:string>>"
        rows = spark.read.schema(f"resolve {entry}, refuse_only {entry}").json(path, multiLine=True)
        good = rows.select(F.explode("resolve").alias("brand", "v")).select("brand", "v.generic", F.lit("resolve").alias("kind"))
        bad = rows.select(F.explode("refuse_only").alias("brand", "v")).select("brand", "v.generic", F.when(F.contains("v.reason", F.lit("combination")), "combination").otherwise("absent").alias("kind"))
        out = good.unionByName(bad)
        out.schema  # noqa: B018  analysis fails here when there is no file
        return out
    except Exception:
        return spark.createDataFrame([], BRANDS)


def write_vectors(vectors: DataFrame, path: str, fingerprint: str, model: str) -> None:
    """Vectors beside one row of what they belong to."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    info = vectors.agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dim"))
    info.select(F.lit(fingerprint).alias("fingerprint"), "count", "dim", F.lit(model).alias("model")).write.mode("overwrite").json(f"{path}/meta")


def cached_vectors(spark: SparkSession, path: str, fingerprint: str, count: int) -> DataFrame | None:
    """Stored vectors, where they belong to this fingerprint and count."""
    try:
        meta = spark.read.schema("fingerprint string, count long, dim int, model string").json(f"{path}/meta").first()
        if meta is None or meta["fingerprint"] != fingerprint or meta["count"] != count:
            return None
        return spark.read.parquet(f"{path}/vectors")
    except Exception:
        return None


def embedded(chunks: DataFrame, encoder, path: str, model: str, use_dense: bool = True) -> tuple[DataFrame | None, dict]:
    """Vectors of chunks (chunk_id, text) and how they came: from the cache where it belongs to these texts, else encoded and
    written. Without use_dense there are none, whatever the encoder; an encoder of None is the default one."""
    if not use_dense:
        return None, {"disabled": True, "cached": False}
    spark = chunks.sparkSession
    n, digest = fingerprint(chunks, model, "chunk_id").first()
    held = cached_vectors(spark, path, digest, n)
    if held is not None:
        return held, {"cached": True, "count": n, "model": model}
    write_vectors(encode(chunks.select("chunk_id", "text"), encoder).select("chunk_id", "embedding"), path, digest, model)
    return cached_vectors(spark, path, digest, n), {"cached": False, "count": n, "model": model}


def write_brands(brands: DataFrame, path: str) -> None:
    """The brand map as one JSON object: resolve and refuse_only by brand."""
    entry = F.struct("generic", "record", F.when(F.col("kind") != "resolve", F.col("kind")).alias("reason"))
    pairs = lambda wanted: F.map_from_entries(F.array_sort(F.collect_list(F.when(wanted, F.struct("brand", entry))), lambda a, b: F.when(a["brand"] < b["brand"], -1).otherwise(1)))
    kinds = F.col("kind") == "resolve"
    brands.agg(pairs(kinds).alias("resolve"), pairs(~kinds).alias("refuse_only")).coalesce(1).write.mode("overwrite").json(path)


def regenerate_brands(brands: DataFrame, path: str, check: bool = False) -> int:
    """Writes the map anew; with check, only compares: 0 where the stored one is up to date, else 1."""
    if check:
        return 0 if same_as_stored(brands.sparkSession, brands, path) else 1
    write_brands(brands, path)
    return 0


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def same_as_stored(spark: SparkSession, brands: DataFrame, path: str) -> bool:
    stored = read_brands(spark, path)
    rows = brands.select("brand", "generic", "kind")
    return rows.exceptAll(stored).isEmpty() and stored.exceptAll(rows).isEmpty()


def secret(name: str, env: dict[str, str], dotenv: str | None = None, default: str | None = None) -> str | None:
    """A driver-side setting: the environment, then a .env file that never overrides it."""
    if env.get(name):
        return env[name]
    for line in (dotenv or "").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and key.strip() == name and not line.lstrip().startswith("#"):
            return value.strip().strip("\"'") or default
    return default


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
