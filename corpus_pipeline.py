"""The corpus pipeline: toxic documents, near-duplicates and benchmark passages go, secrets are masked, sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in the shared folder
and hands them to the next. All but the last return the columns of docs. The last returns one row for each remaining row:
doc_id, size, source_size, target, copies and taken.

Rows with a null text or id, empty and very long texts, repeated rows and empty tables pass every stage as its operator states:
a null or empty text is not toxic, near nothing, clean and without secrets; of rows that are copies of each other one stays,
whatever their ids. Columns that are not used pass through, whatever their names, as long as doc_id, text and source are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.common import columns, forget, row_numbers, scope, table, written
from ledgerwell.llm.decontam import decontaminate
from ledgerwell.llm.mixing import mix
from ledgerwell.llm.neardup import groups
from ledgerwell.llm.secrets import redact
from ledgerwell.llm.toxicity import fit, scored, training_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(body: Stage) -> Stage:
    """A stage whose own tables are deleted when the next one starts, as its rows are written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, "pipeline")
        with scope("pipeline"):
            return body(spark, docs, sf_dir)

    return run_stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxic score of 0.5 or more."""
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return scored(docs, model).where(F.col("score") < 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that with the least id (null last), by five-word shingles and a similarity of 0.8."""
    rows = row_numbers(docs.select(F.struct(*columns(docs)).alias("own"), "doc_id", "text"), "rows")
    gone = groups(rows.select(F.col("row").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select("own.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes. Null and empty texts stay as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken to bring its source to its target."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


_BODIES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
STAGES: list[tuple[str, Stage]] = [(name, _stage(body)) for name, body in _BODIES]

#: The scores of a trained machine can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's own tables, and the rows it read, are deleted once its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, body in _BODIES:
        tag = f"{name}-{id(docs)}"
        with scope(f"{tag}-own"):
            out = body(spark, docs, sf_dir)
        with scope(tag):
            docs = written(out, name)
        forget(spark, f"{tag}-own")
        if before:
            forget(spark, before)
        before = tag
    return docs
