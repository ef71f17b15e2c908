"""The pair table: loading, name resolution, lookups, lists."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.functions import lists, text



def level_rank(level: Column) -> Column:
    """Rank of a severity; unknown text ranks 0."""
    out = F.lit(0)
    for name, rank in lists.LEVEL_RANK.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def level_name(rank: Column) -> Column:
    out = F.lit("Unknown")
    for name, r in lists.LEVEL_RANK.items():
        out = F.when(rank == r, name).otherwise(out)
    return out


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a_name, b_name, level, ord) of CSV files in order of file name and place."""
    rows = spark.read.schema("id_a string, a_name string, id_b string, b_name string, level string").option("header", True).option("enforceSchema", True).csv(path)
    return rows.select(F.trim("a_name").alias("a_name"), F.trim("b_name").alias("b_name"), F.trim("level").alias("level"), F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")).alias("ord"))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("a_name is not null and b_name is not null and a_name <> '' and b_name <> '' and a_name <> b_name")


def severest(rows: DataFrame) -> DataFrame:
    """(a, b, level, rank) with a < b: the most severe level of each unordered pair, by lower-case name."""
    a, b = F.lower("a_name"), F.lower("b_name")
    per = usable(rows).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(level_rank(F.col("level"))).alias("rank"))
    return per.select("a", "b", level_name(F.col("rank")).alias("level"), "rank")


def names(rows: DataFrame) -> DataFrame:
    """(name, display, tokens): each name once, shown as first met."""
    both = usable(rows).select(F.explode(F.array(F.struct(F.col("a_name").alias("n"), F.struct("ord", F.lit(0).alias("side")).alias("o")), F.struct(F.col("b_name").alias("n"), F.struct("ord", F.lit(1).alias("side")).alias("o")))).alias("x"))
    per = both.groupBy(F.lower("x.n").alias("name")).agg(F.min_by("x.n", "x.o").alias("display"))
    return per.withColumn("tokens", F.array_sort(text.identity_tokens(F.col("name"), lists.PAIR_SALT_WORDS)))


def resolve(inputs: DataFrame, known: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """(input, name, step) of distinct inputs: synonym, then exact, equal tokens, all tokens, nearest spelling."""
    synonyms = F.create_map(*(F.lit(x) for kv in lists.SYNONYMS.items() for x in kv))
    raw = F.lower(F.trim("input"))
    asked = inputs.select("input").distinct().where(F.trim("input") != "").withColumn("raw", F.coalesce(F.element_at(synonyms, raw), raw))
    asked = asked.withColumn("wanted", F.array_sort(text.identity_tokens(F.col("raw"), lists.PAIR_SALT_WORDS)))
    exact = asked.join(known.select(F.col("name").alias("raw"), F.col("name")), "raw").select("input", "name", F.lit(1).alias("step"), F.lit(0).alias("n"))
    by_token = known.select("name", "tokens", F.explode("tokens").alias("token"))
    hits = asked.select("input", "wanted", F.explode("wanted").alias("token")).join(by_token, "token").groupBy("input", "wanted", "name", "tokens").agg(F.count("*").alias("m"))
    hits = hits.where(F.col("m") == F.size("wanted"))
    superset = hits.select("input", "name", F.when(F.col("tokens") == F.col("wanted"), 2).otherwise(3).alias("step"), F.size("tokens").alias("n"))
    found = exact.unionByName(superset)
    order = Window.partitionBy("input").orderBy("step", "n", F.length("name"), "name")
    best = found.withColumn("k", F.row_number().over(order)).where("k = 1").select("input", "name", "step")
    rest = asked.join(best, "input", "left_anti").where(F.size("wanted") > 0)
    return best.unionByName(_nearest(rest, known, cutoff))


def _nearest(rest: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """Names by sequence ratio; a pair of characters in common and near lengths are needed at such a cutoff."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    left = rest.select("input", "raw", F.explode(pairs(F.col("raw"))).alias("p"))
    right = known.select("name", F.explode(pairs(F.col("name"))).alias("p"))
    near = left.join(right, "p").groupBy("input", "raw", "name").agg(F.count("*").alias("m"))
    near = near.where(2 * F.least(F.length("raw"), F.length("name")) >= cutoff * (F.length("raw") + F.length("name")))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)])

    scored = near.withColumn("r", ratio("raw", "name")).where(F.col("r") >= cutoff)
    return scored.groupBy("input").agg(F.max_by("name", F.struct("r", "name")).alias("name")).select("input", "name", F.lit(5).alias("step"))


def check(asked: DataFrame, resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """status, level and rank for rows with input_a and input_b; absence from the table never reads as unknown."""
    ra = resolved.select(F.col("input").alias("input_a"), F.col("name").alias("ca"))
    rb = resolved.select(F.col("input").alias("input_b"), F.col("name").alias("cb"))
    rows = asked.join(ra, "input_a", "left").join(rb, "input_b", "left").withColumn("a", F.least("ca", "cb")).withColumn("b", F.greatest("ca", "cb"))
    rows = rows.join(pairs, ["a", "b"], "left")
    status = F.when(F.col("ca").isNull() | F.col("cb").isNull(), "unknown_drug").when(F.col("ca") == F.col("cb"), "same_drug").when(F.col("level").isNull(), "no_interaction").otherwise("ok")
    return rows.withColumn("status", status).drop("a", "b")


def split_list(column: Column) -> Column:
    return F.filter(F.transform(F.split(column, r"[\n,;]+"), lambda x: F.trim(x)), lambda x: x != "")


def list_items(lists_: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items (list_id, pos, input) of lists written in a field, and the lists that name fewer than two, which can't be checked."""
    rows = lists_.select("list_id", split_list(F.col(column)).alias("names"))
    short = rows.where(F.size("names") < 2).select("list_id", F.size("names").alias("n_drugs"), F.lit("too_few").alias("status"))
    return rows.where(F.size("names") >= 2).select("list_id", F.posexplode("names").alias("pos", "input")), short


def check_lists(items: DataFrame, resolved: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (list_id, pos, input): the found pairs in order of severity and place, and a summary of each list."""
    known = items.join(resolved.select("input", "name"), "input", "left")
    a = known.where("name is not null").select("list_id", F.col("pos").alias("pos_a"), F.col("input").alias("input_a"))
    b = known.where("name is not null").select("list_id", F.col("pos").alias("pos_b"), F.col("input").alias("input_b"))
    checked = check(a.join(b, "list_id").where("pos_a < pos_b"), resolved, pairs)
    found = checked.where("status = 'ok'").withColumn("place", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("rank"), "pos_a", "pos_b")))
    counts = checked.groupBy("list_id").agg(*(F.count_if((F.col("status") == "ok") & (F.col("level") == name)).alias(name.lower()) for name in lists.LEVEL_RANK), F.count_if(F.col("status") == "no_interaction").alias("safe_pairs"))
    every = known.groupBy("list_id").agg(F.count("*").alias("n_drugs"), F.array_sort(F.collect_set(F.when(F.col("name").isNull(), F.col("input")))).alias("unresolved"))
    zero = [name.lower() for name in lists.LEVEL_RANK] + ["safe_pairs"]
    return found, every.join(counts, "list_id", "left").na.fill(0, zero)


def summary_text(row: DataFrame) -> DataFrame:
    """A sentence for each list; unresolved names never read as clear."""
    names_ = [n for n in lists.LEVEL_RANK]
    counts = F.array_join(F.filter(F.array(*(F.when(F.col(n.lower()) > 0, F.concat(F.col(n.lower()).cast("string"), F.lit(" " + n))) for n in names_)), lambda x: x.isNotNull()), ", ")
    total = sum((F.col(n.lower()) for n in names_), F.lit(0))
    head = F.when(total > 0, F.concat(total.cast("string"), F.lit(" documented interaction(s) ("), counts, F.lit(")"))).when(F.size("unresolved") == 0, F.concat(F.lit("No documented interactions ("), F.col("safe_pairs").cast("string"), F.lit(" pair(s) checked)")))
    tail = F.when(F.size("unresolved") > 0, F.concat(F.lit("Not in the table, skipped: "), F.array_join("unresolved", ", ")))
    return row.withColumn("message", F.concat_ws("\n", head, tail))
