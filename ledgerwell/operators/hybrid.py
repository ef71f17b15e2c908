"""Blending, restriction, boost, floor, ranking and abstention, for batches of queries.

Scores are scaled over all chunks of a query, before any restriction; chunks without a lexical score count as 0 there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.operators.dense import cosine
from ledgerwell.operators.lexical import top
from ledgerwell.session import stored


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0.5 where all are equal."""
    return F.when(high - low < 1e-12, 0.5).otherwise((value - low) / (high - low))


def _with_zero(low: str, high: str, present: str) -> list[Column]:
    """Bounds over all chunks: what is absent from a sparse score counts as 0."""
    gap = F.col(present) < F.col("n_chunks")
    zero = F.lit(0.0)
    return [F.when(gap, F.least(low, zero)).otherwise(F.col(low)).alias(low), F.when(gap, F.greatest(high, zero)).otherwise(F.col(high)).alias(high)]


def scale(bm25: DataFrame, dense: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25, dense, lexical_part, dense_part): raw scores and both scaled over all chunks of a query.

    Both kinds of scores meet in one grouping, which is written once; bounds and parts read that table.
    """
    none = F.lit(None).cast("double")
    rows = bm25.select("query_id", "chunk_id", "bm25", none.alias("dense")).unionByName(dense.select("query_id", "chunk_id", none.alias("bm25"), "dense"))
    both = stored(rows.groupBy("query_id", "chunk_id").agg(F.max("bm25").alias("bm25"), F.max("dense").alias("dense")), "scores")
    n = chunks.agg(F.count("*").alias("n_chunks"))  # one row
    ends = both.groupBy("query_id").agg(F.min("bm25").alias("blo"), F.max("bm25").alias("bhi"), F.count("bm25").alias("bn"), F.min("dense").alias("dlo"), F.max("dense").alias("dhi"), F.count("dense").alias("dn")).na.fill(0.0, ["blo", "bhi", "dlo", "dhi"])
    ends = ends.crossJoin(n).select("query_id", *_with_zero("blo", "bhi", "bn"), *_with_zero("dlo", "dhi", "dn"))
    rows = both.na.fill(0.0, ["bm25", "dense"]).join(ends, "query_id")
    return rows.select("query_id", "chunk_id", "bm25", "dense", minmax(F.col("bm25"), F.col("blo"), F.col("bhi")).alias("lexical_part"), minmax(F.col("dense"), F.col("dlo"), F.col("dhi")).alias("dense_part"))


def blend(bm25: DataFrame, dense: DataFrame | None, chunks: DataFrame, alpha: float = 0.20) -> DataFrame:
    """(query_id, chunk_id, bm25, dense, score). Without dense scores, the raw lexical score ranks."""
    if dense is None:
        return bm25.select("query_id", "chunk_id", "bm25", F.lit(None).cast("double").alias("dense"), F.col("bm25").alias("score"))
    score = alpha * F.col("lexical_part") + (1 - alpha) * F.col("dense_part")
    return scale(bm25, dense, chunks).select("query_id", "chunk_id", "bm25", "dense", score.alias("score"))


def blend_pairs(pairs: DataFrame, bm25: DataFrame, vectors: DataFrame, wanted: DataFrame, ends: DataFrame, chunks: DataFrame, alpha: float = 0.20) -> DataFrame:
    """blend() for given (query_id, chunk_id) alone: dense scores are computed for those, and their bounds over all chunks
    (query_id, lo, hi) come from elsewhere, so that no table of all chunks by all queries is made."""
    n = chunks.agg(F.count("*").alias("n_chunks"))
    lexical = bm25.groupBy("query_id").agg(F.min("bm25").alias("blo"), F.max("bm25").alias("bhi"), F.count("*").alias("bn")).crossJoin(n).select("query_id", *_with_zero("blo", "bhi", "bn"))
    rows = pairs.join(wanted, "query_id").join(vectors, "chunk_id").select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("q")).alias("dense"))
    rows = rows.join(bm25, ["query_id", "chunk_id"], "left").join(lexical, "query_id", "left").join(ends, "query_id", "left").na.fill(0.0, ["bm25", "blo", "bhi", "lo", "hi"])
    score = alpha * minmax(F.col("bm25"), F.col("blo"), F.col("bhi")) + (1 - alpha) * minmax(F.col("dense"), F.col("lo"), F.col("hi"))
    return rows.select("query_id", "chunk_id", "bm25", "dense", score.alias("score"))


def lab(scaled: DataFrame, alphas: tuple[float, ...], k: int, floor: bool = True, emb: float = 0.25, lex: float = 1.0) -> DataFrame:
    """(alpha, query_id, chunk_id, score, rank): the ranking at each of several blends, with the floor or without it."""
    rows = scaled.where(above_floor(emb, lex)) if floor else scaled
    rows = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    rows = rows.withColumn("score", F.col("alpha") * F.col("lexical_part") + (1 - F.col("alpha")) * F.col("dense_part"))
    order = Window.partitionBy("alpha", "query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("alpha", "query_id", "chunk_id", "score", "rank")


def restrict(scored: DataFrame, wanted: DataFrame, tokens: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """Keeps chunks that hold a matched token (query_id, token), and uploads; a query left with nothing keeps all."""
    allowed = tokens.join(wanted, "token").select("query_id", "chunk_id").distinct().withColumn("ok", F.lit(True))
    rows = scored.join(allowed, ["query_id", "chunk_id"], "left")
    if uploads is not None:
        rows = rows.join(uploads.select("chunk_id", F.lit(True).alias("up")), "chunk_id", "left").withColumn("ok", F.coalesce("ok", "up")).drop("up")
    any_ = F.max(F.coalesce("ok", F.lit(False))).over(Window.partitionBy("query_id"))
    return rows.withColumn("any", any_).where(F.coalesce("ok", F.lit(False)) | ~F.col("any")).drop("ok", "any")


def boost(rows: DataFrame, chunks: DataFrame, weights: DataFrame, strength: float = 0.20) -> DataFrame:
    """Multiplies scores by 1 + strength * weight / top weight of the query, by the chunk's field; adds field."""
    best = weights.withColumn("top", F.max("weight").over(Window.partitionBy("query_id")))
    rows = rows.join(chunks.select("chunk_id", "field"), "chunk_id").join(best, ["query_id", "field"], "left")
    factor = F.when(F.col("top") > 0, 1 + strength * F.col("weight") / F.col("top")).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * F.coalesce(factor, F.lit(1.0))).drop("weight", "top")


def above_floor(emb: float = 0.25, lex: float = 1.0) -> Column:
    """Raw scores decide: similar enough, or lexical enough."""
    return (F.coalesce("dense", F.lit(float("-inf"))) >= emb) | (F.coalesce("bm25", F.lit(0.0)) >= lex)


def ranked(rows: DataFrame, k: int, emb: float = 0.25, lex: float = 1.0) -> DataFrame:
    return top(rows.where(above_floor(emb, lex)), k, "score")


def reranked(rows: DataFrame, k: int, rerank: Column, pool: int = 40, emb: float = 0.25, lex: float = 1.0) -> DataFrame:
    """The first `pool` by score, then the floor, then the best k by another score, which replaces the first."""
    first = top(rows, pool, "score").where(above_floor(emb, lex)).drop("rank").withColumn("score", rerank)
    return top(first, k, "score")


def statuses(outcomes: DataFrame, results: DataFrame, has_uploads: bool = False) -> DataFrame:
    """One row a query: status and number of results."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n_results"))
    rows = outcomes.join(n, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    blocked = (F.size("matched") == 0) & F.lit(not has_uploads)
    status = F.when(blocked & (F.size("unknown") > 0), "unknown_entity").when(blocked, "no_entity").when(F.col("n_results") == 0, "no_relevant_context").otherwise("ok")
    return rows.withColumn("status", status).withColumn("n_results", F.when(blocked, 0).otherwise(F.col("n_results")))


def shares(alpha: float, is_reranked: bool = False) -> list[Column]:
    """Lexical, dense and rerank parts of a score bar, rescaled to 1."""
    lexical, dense, rerank = (F.lit(0.0), F.lit(0.0), F.lit(1.0)) if is_reranked else (alpha * F.col("bm25"), (1 - alpha) * F.col("dense"), F.lit(0.0))
    total = F.greatest(lexical + dense + rerank, F.lit(1e-9))
    return [(lexical / total).alias("lexical_share"), (dense / total).alias("dense_share"), (rerank / total).alias("rerank_share")]


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two result sets by side: only in a, only in b, in both."""
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.subtract(b), "only_a").unionByName(side(b.subtract(a), "only_b")).unionByName(side(a.intersect(b), "both"))
