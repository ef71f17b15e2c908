"""Measures of retrieval against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Statuses of a persona's policy, rather than of a search that failed.
POLICY_STATUSES = ("red_flag", "medication_change", "persona_field_policy", "interaction_referral", "interaction")


def first_hit(cases: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Every case with the first rank at which its truth is met, or null."""
    hits = cases.join(results, on).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return cases.select("query_id").distinct().join(hits, "query_id", "left")


def recall_mrr(cases: DataFrame, results: DataFrame, on: list[str], k: int = 5) -> DataFrame:
    f = first_hit(cases, results, on)
    return f.agg(F.count("*").alias("cases"), F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def precision_at(cases: DataFrame, results: DataFrame, on: list[str], k: int = 5) -> DataFrame:
    """Mean over queries: share of the first k results that are relevant, share of relevant ones found, any found."""
    hit = results.where(F.col("rank") <= k).join(cases.distinct(), on, "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    want = cases.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    per = want.join(hit, "query_id", "left").na.fill(0, ["hits"])
    return per.agg(F.avg(F.col("hits") / k).alias("precision"), F.avg(F.col("hits") / F.col("relevant")).alias("recall"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"))


def refusals(statuses: DataFrame, must_refuse: str = "must_refuse") -> DataFrame:
    """Share of right refusals among must-refuse queries, of false ones among the others."""
    refused = (F.col("status") != "ok").cast("double")
    return statuses.agg(F.avg(F.when(F.col(must_refuse), refused)).alias("refusal_accuracy"), F.avg(F.when(~F.col(must_refuse), refused)).alias("false_refusals"))


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Share of right guesses, and how many have none; a null guess is wrong."""
    return rows.agg(F.avg(F.coalesce((F.col(truth) == F.col(guess)).cast("double"), F.lit(0.0))).alias("accuracy"), F.count_if(F.col(guess).isNull()).alias("unmatched"))


def by_policy(cases: DataFrame, allowed: frozenset[str] | None) -> DataFrame:
    """Recall over cases whose field a persona may read, and how many it may not. Needs field, first_rank."""
    ok = F.col("field").isin(*allowed) if allowed is not None else F.lit(True)
    hit = F.col("first_rank").isNotNull().cast("double")
    return cases.agg(F.count_if(ok).alias("in_policy"), F.count_if(~ok).alias("out_of_policy"), F.avg(F.when(ok, hit)).alias("recall_in_policy"))


def persona_metrics(cases: DataFrame, allowed: frozenset[str] | None, blocked: frozenset[str] = frozenset()) -> DataFrame:
    """One row about the cases of a persona (status, drug_hit, field, first_rank, context_chars, ms, must_refuse).

    A refusal by the persona's policy is no miss of retrieval; recall by field counts only answered cases whose field the
    persona may read. Shares without any case are null.
    """
    asked, refused = ~F.col("must_refuse"), F.col("status") != "ok"
    by_policy_ = refused & F.col("status").isin(*POLICY_STATUSES)
    answered = asked & ~refused
    may = F.coalesce(~F.col("field").isin(*blocked), F.lit(False)) if blocked else F.col("field").isNotNull()
    may = may & (F.col("field").isin(*allowed) if allowed is not None else F.lit(True))
    rank = F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))
    return cases.agg(
        F.count_if(answered).alias("answered"), F.count_if(answered & may).alias("in_policy"), F.count_if(answered & ~may).alias("out_of_policy"),
        F.avg(F.when(answered, F.col("drug_hit").cast("double"))).alias("drug_recall"),
        F.avg(F.when(answered & may, F.col("first_rank").isNotNull().cast("double"))).alias("field_recall"), F.avg(F.when(answered & may, rank)).alias("field_mrr"),
        F.count_if(asked & by_policy_).alias("policy_refusals"), F.count_if(asked & refused & ~by_policy_).alias("retrieval_misses"),
        F.avg(F.when(~asked, refused.cast("double"))).alias("refusal_accuracy"), F.avg(F.when(answered, F.col("context_chars"))).alias("mean_context_chars"), F.avg(F.when(asked, F.col("ms"))).alias("mean_ms"),
    )


def pair_accuracy(cases: DataFrame) -> DataFrame:
    """Share of right pair lookups (want_level or want_status against level and status)."""
    right = F.when(F.col("want_level").isNotNull(), (F.col("status") == "ok") & F.col("level").eqNullSafe(F.col("want_level"))).otherwise(F.col("status").eqNullSafe(F.col("want_status")))
    return cases.agg(F.count("*").alias("pairs"), F.avg(right.cast("double")).alias("interaction_accuracy"))


def sweep(cases: DataFrame, results: DataFrame, on: list[str], setting: str, k: int = 5) -> DataFrame:
    """(setting, recall, mrr) of results at several settings."""
    hits = cases.join(results, on).groupBy(setting, "query_id").agg(F.min("rank").alias("first_rank"))
    every = results.select(setting).distinct().crossJoin(cases.select("query_id").distinct())  # a few settings by the cases
    rows = every.join(hits, [setting, "query_id"], "left")
    return rows.groupBy(setting).agg(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def choose(sweep: DataFrame, setting: str) -> DataFrame:
    """The setting with the best first measure, then the best of the others, then the smallest setting."""
    best = sweep.withColumn("r", F.rank().over(Window.orderBy(F.desc(F.round("recall", 9))))).where("r = 1")
    return best.orderBy(F.desc(F.round("field_recall", 9)), F.desc(F.round("mrr", 9)), setting).limit(1).drop("r")
