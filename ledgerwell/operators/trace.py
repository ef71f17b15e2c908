"""What each step of a retrieval took in and gave out, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwell.functions import text

SCHEMA = "query_id bigint, step int, name string, rows_in bigint, rows_out bigint, dropped map<string, bigint>, top_scores array<double>"


def step(number: int, name: str, before: DataFrame, after: DataFrame, reason: str, score: str = "score") -> DataFrame:
    """Counts of a step for each query, with what it dropped and its best three scores."""
    a = before.groupBy("query_id").agg(F.count("*").alias("rows_in"))
    b = after.groupBy("query_id").agg(F.count("*").alias("rows_out"), F.slice(F.sort_array(F.collect_set(F.round(score, 4)), asc=False), 1, 3).alias("top_scores"))
    rows = a.join(b, "query_id", "left").withColumn("rows_out", F.coalesce("rows_out", F.lit(0)))
    gone = F.col("rows_in") - F.col("rows_out")
    dropped = F.when(gone > 0, F.create_map(F.lit(reason), gone)).otherwise(F.create_map().cast("map<string,bigint>"))
    return rows.select("query_id", F.lit(number).alias("step"), F.lit(name).alias("name"), "rows_in", "rows_out", dropped.alias("dropped"), F.coalesce("top_scores", F.array().cast("array<double>")).alias("top_scores"))


def total_ms(steps: list[tuple[str, float]]) -> float:
    """Milliseconds of all steps of a batch, as measured around their writes."""
    return float(sum(ms for _, ms in steps))


def drop_totals(trace: DataFrame) -> DataFrame:
    """(reason, n) over all steps."""
    return trace.select(F.explode("dropped").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def summary() -> Column:
    """One line for a step."""
    why = F.array_join(F.transform(F.map_entries("dropped"), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")
    return F.concat(F.lit("kept "), F.col("rows_out").cast("string"), F.lit(" of "), F.col("rows_in").cast("string"), F.when(why != "", F.concat(F.lit(", dropped "), why)).otherwise(""))


def context_size(context: Column) -> Column:
    """struct of characters, words, estimated tokens and sources of a packed context."""
    words = text.word_count(context)
    return F.struct(F.length(context).cast("long").alias("chars"), words.alias("words"), F.floor(words * 1.3).alias("tokens"), F.regexp_count(context, F.lit(r"\[Source ")).cast("long").alias("sources"))
