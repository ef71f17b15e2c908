"""The best BM25 scores of each query without a row for every posting and query.

Postings are packed: one row for each shard of documents and term, with the documents, their score parts and the largest part.
Shards meet blocks of queries, so that a posting is read once for a whole block, and only the best k of a shard and query leave a
task. Inside a shard the terms of a query are taken by falling bound; once those that are left can't lift a document over the
k-th score so far, only documents that could still get there are completed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwell.operators.lexical import Index, idf_table, terms_of, top
from ledgerwell.session import stored

#: Documents of a shard, and queries of a block.
DOCUMENTS, QUERIES = 16_384, 4096


@dataclass
class Shards:
    """packed (shard, term, chunks, parts, best), idf (term, idf) and the number of shards."""

    packed: DataFrame
    idf: DataFrame
    count: int


def packed(index: Index, k1: float = 1.5, b: float = 0.75, idf: str = "plus1", terms: DataFrame | None = None, documents: int = DOCUMENTS) -> Shards:
    """An index in shards, written. terms: the only terms (term) that are packed, for an index that serves one batch."""
    n = index.totals.first()["n"]
    count = max(1, -(-n // documents))
    known, postings = index, index.postings
    if terms is not None:
        postings = stored(postings.join(terms.select("term").distinct(), "term", "left_semi"), "asked-postings")
        if idf == "plus1":
            known = Index(postings, index.lengths, postings.groupBy("term").agg(F.count("*").alias("df")), index.totals)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = postings.join(index.lengths, "chunk_id").crossJoin(index.totals.select("avgdl")).select(F.pmod(F.xxhash64("chunk_id"), F.lit(count)).cast("int").alias("shard"), "term", "chunk_id", part.alias("part"))
    lists = rows.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "part"))).alias("x"), F.max("part").alias("best"))
    return Shards(stored(lists.select("shard", "term", F.col("x.chunk_id").alias("chunks"), F.col("x.part").alias("parts"), "best"), "packed"), stored(idf_table(known, idf), "idf"), count)


def _scores(terms: list[tuple[float, np.ndarray, np.ndarray, float]], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents that may be among the best k: of each term its weight, places, parts and largest part."""
    terms = sorted(terms, key=lambda t: -t[0] * t[3])
    left = np.append(np.cumsum([w * best for w, _, _, best in terms][::-1])[::-1], 0.0)
    acc = np.zeros(n)
    for j, (w, at, parts, _) in enumerate(terms):
        acc[at] += w * parts
        least = np.partition(acc, n - k)[n - k] if n >= k else 0.0
        if left[j + 1] < least - 1e-6:
            some = np.flatnonzero(acc + left[j + 1] >= least - 1e-6)
            for w2, at2, parts2, _ in terms[j + 1 :]:
                place = np.minimum(np.searchsorted(at2, some), len(at2) - 1)
                acc[some] += np.where(at2[place] == some, w2 * parts2[place], 0.0)
            return some, acc[some]
    some = np.flatnonzero(acc)
    return some, acc[some]


def best(shards: Shards, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, bm25, rank) of query_id, clean: the same as all scores cut to the best k."""
    asked = stored(terms_of(queries, "query_id", "clean").join(shards.idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight")), "asked-terms")
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    held = shards.packed.join(asked.select("term").distinct(), "term", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards.count - 1))))

    def meet(lists: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([*lists.chunks, np.zeros(0, np.int64)]).astype(np.int64))
        by = {t: (np.searchsorted(names, c), np.asarray(p, np.float64), b) for t, c, p, b in zip(lists.term, lists.chunks, lists.parts, lists.best, strict=True)}
        out = []
        for query, rows in wanted[wanted.term.isin(by.keys())].groupby("query_id"):
            some, score = _scores([(w, *by[t]) for t, w in zip(rows.term, rows.weight, strict=True)], len(names), k)
            order = np.lexsort((names[some], -np.round(score, 9)))[:k]
            out.append(pd.DataFrame({"query_id": query, "chunk_id": names[some[order]], "bm25": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "bm25": []})

    found = held.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(meet, "query_id bigint, chunk_id bigint, bm25 double")
    return top(found, k, "bm25")
