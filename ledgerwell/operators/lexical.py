"""Lexical index as plain tables, BM25 and TF-IDF.

postings (term, chunk_id, tf), lengths (chunk_id, dl), frequencies (term, df) and one row of totals (n, avgdl). Queries are
tables too; the join on term touches only chunks with a query term, and its size decides how Spark runs it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions import text
from ledgerwell.session import stored


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def terms_of(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf) of the space-separated tokens of a cleaned column."""
    return rows.select(key, F.explode(text.tokens(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def build_index(chunks: DataFrame, key: str = "chunk_id", column: str = "clean") -> Index:
    postings = terms_of(chunks, key, column).select("term", F.col(key).alias("chunk_id"), "tf")
    lengths = chunks.select(F.col(key).alias("chunk_id"), F.size(text.tokens(F.col(column))).cast("long").alias("dl"))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, lengths, frequencies, totals)


def idf_table(index: Index, kind: str = "plus1") -> DataFrame:
    """(term, idf): ln(1 + (N - n + 0.5) / (n + 0.5)), or its classic form, negative values as a quarter of the mean."""
    rows = index.frequencies.crossJoin(index.totals)
    if kind == "plus1":
        return rows.select("term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    raw = rows.select("term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.crossJoin(mean).select("term", F.when(F.col("idf") < 0, 0.25 * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def bm25(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, idf: str = "plus1") -> DataFrame:
    """(query_id, chunk_id, bm25) for query_id, clean; repeated query terms count again; chunks without a term are absent."""
    wanted = terms_of(queries, "query_id", "clean").withColumnRenamed("tf", "qtf")
    asked = wanted.select("term").distinct()
    # the semi join moves below the grouping of an index that isn't stored, so only query terms are counted; they are written
    # once, as both their frequencies and the scores read them
    postings = stored(index.postings.join(asked, "term", "left_semi"), "asked-postings")
    known = index if idf != "plus1" else Index(postings, index.lengths, postings.groupBy("term").agg(F.count("*").alias("df")), index.totals)
    hits = wanted.join(idf_table(known, idf), "term").join(postings, "term").join(index.lengths, "chunk_id").crossJoin(index.totals.select("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def top(scores: DataFrame, k: int, score: str, key: str = "chunk_id") -> DataFrame:
    """The k best of each query, ties by the smaller key, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grams(words, n: int = 2):
    """Words and their pairs."""
    pairs = F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))
    return F.concat(words, pairs) if n == 2 else words


def _gram_words(column):
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("([A-Za-z0-9_]{2,})"), F.lit(1))


def gram_hashes(column):
    """64-bit hashes of the words of a text and of their pairs: of a pair, the hash of both words, so that no string is built."""

    def every(w):
        pairs = F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
        return F.concat(F.transform(w, lambda x: F.xxhash64(x)), pairs)

    return F.transform(F.array(_gram_words(column)), every)[0]


def _gram_counts(rows: DataFrame, key: str, column: str, hashed: bool = False) -> DataFrame:
    """(key, term, tf) of words and pairs of words, or of their 64-bit hashes."""
    found = rows.select(key, F.explode(gram_hashes(F.col(column))).alias("term")) if hashed else rows.select(key, _gram_words(column).alias("w")).select(key, F.explode(grams(F.col("w"))).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _idf(tf: DataFrame, rows: DataFrame, min_df: int) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    return tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).crossJoin(n).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(rows: DataFrame, key: str, column: str, min_df: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, term, weight) with unit rows, and the learned (term, idf)."""
    tf = _gram_counts(rows, key, column)
    idf = _idf(tf, rows, min_df)
    return weighted(tf, idf, key), idf


def weighted(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Unit rows; the norm is taken over the same dealing of rows by key as the weights."""
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def tfidf_queries(queries: DataFrame, idf: DataFrame, column: str) -> DataFrame:
    """Queries in a learned space; unknown terms are dropped."""
    return weighted(_gram_counts(queries, "query_id", column), idf, "query_id")


def tfidf_scores(docs: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    q = queries.withColumnRenamed("weight", "qw")
    return docs.join(q, "term").groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("qw")).alias("cosine"))


def gram_counts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf) of hashed words and pairs of words, written: what tfidf_cosine reads of a corpus."""
    return stored(_gram_counts(rows, key, column, hashed=True), "gram-counts")


def tfidf_cosine(rows: DataFrame, queries: DataFrame, key: str, column: str, min_df: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, key, cosine) of queries (query_id and the same column) with the rows that share a term.

    The space is learned from all rows, but only weights of query terms are kept: a row's other terms go into its norm where
    they are summed, so that the shuffle by row carries one partial sum a task and the few weights that can score. Terms are told by
    64-bit hashes: among a billion different ones, two share a hash with a chance of 3 %. counts: gram_counts() of the rows, where
    they are kept.
    """
    asked = _gram_counts(queries, "query_id", column, hashed=True).withColumnRenamed("tf", "qtf")
    tf = gram_counts(rows, key, column) if counts is None else counts  # read for the frequencies, and for the weights
    idf = _idf(tf, rows, min_df)
    known = stored(idf.join(asked.select("term").distinct(), "term", "left_semi"), "idf")  # the terms of the queries
    q = asked.join(known, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    q = q.withColumn("qw", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id"))))
    wanted = q.select("term").distinct().withColumn("wanted", F.lit(True))
    w = F.col("tf") * F.col("idf")
    raw = tf.join(idf, "term").join(wanted, "term", "left").select(key, w.alias("w"), F.when(F.col("wanted"), F.struct("term", w.alias("w"))).alias("hit"))
    per = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list("hit").alias("hits"))
    hits = per.select(key, "norm", F.explode("hits").alias("x")).select(key, "x.term", (F.col("x.w") / F.col("norm")).alias("weight"))
    return hits.join(q.select("query_id", "term", "qw"), "term").groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("qw")).alias("cosine"))
