"""Dense vectors: encoding, exact and cell-based top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.operators.lexical import top
from ledgerwell.session import new_path

#: Queries that go to the vectors in one pass (more come in further passes), and those in one matrix product.
BLOCK, STEP = 8192, 512
#: Vectors from which on cells pay, and without which they can't be trained.
CELLS_FROM, LEAST_VECTORS = 50_000, 320


def hashing_encoder(dim: int = 64):
    """A deterministic stand-in for a model: signed hashed tokens, unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode(rows: DataFrame, encoder=None, column: str = "text", batch: int = 64) -> DataFrame:
    """Adds embedding; the encoder maps a list of texts to unit rows. One instance serves a worker's batches."""
    encoder = encoder or hashing_encoder()

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in encoder(texts[k : k + batch])])

    return rows.withColumn("embedding", run(F.col(column)))


def cosine(a, b):
    """Dot product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_error(vectors: DataFrame) -> DataFrame:
    """The largest distance of a row's length from 1, and the number of rows."""
    norm = F.sqrt(cosine(F.col("embedding"), F.col("embedding")))
    return vectors.agg(F.count("*").alias("n"), F.max(F.abs(norm - 1)).alias("worst"))


def require_unit(vectors: DataFrame, tolerance: float = 1e-3, rows: int = 256) -> DataFrame:
    worst = norm_error(vectors.limit(rows)).first()["worst"]
    if worst is not None and worst > tolerance:
        raise ValueError(f"vectors are not of unit length (off by {worst:.3g})")
    return vectors


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles, from its flat buffer."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries in blocks, in order of id, read one partition at a time."""
    block: list = []
    for row in queries.select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
            block = []
    if block:
        yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)


def best_rows(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each column at 9 decimals, ties by the smaller name; -inf is none."""
    rounded = -np.round(scores, 9)
    last = np.partition(rounded, min(k, len(rounded)) - 1, axis=0)[min(k, len(rounded)) - 1]
    column, row = np.nonzero(((rounded <= last) & (rounded < np.inf)).T)
    order = np.lexsort((names[row], rounded[row, column], column))
    column, row = column[order], row[order]
    first = np.searchsorted(column, column)
    kept = np.arange(len(column)) - first < k
    return row[kept], column[kept]


def _union(parts: list[DataFrame], vectors: DataFrame, schema: str) -> DataFrame:
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): exact. Blocks of queries visit all vectors as matrix products of STEP queries; each batch of
    vectors hands on its own best k of a query, so what is shuffled is k rows a batch and query."""
    schema = f"query_id bigint, {key} bigint, score double"

    def visit(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, names = matrix(b.column(1)), b.column(0).to_numpy()
                for at in range(0, len(ids) if b.num_rows else 0, STEP):
                    scores = x @ q[at : at + STEP].T
                    row, column = best_rows(scores, names, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + column]), pa.array(names[row]), pa.array(scores[row, column])], ["query_id", key, "score"])

        return vectors.select(key, "embedding").mapInArrow(run, schema)

    return top(_union([visit(*block) for block in _query_blocks(queries)], vectors, schema), k, "score", key)


def grouped_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", group: str = "field") -> DataFrame:
    """(query_id, key, score, rank): the best k of each query in each group of the vectors (key, embedding, group), exact. What is
    shuffled is k rows a batch, group and query, never a row for each pair."""
    schema = f"query_id bigint, {key} bigint, {group} string, score double"

    def visit(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, names, groups = matrix(b.column(1)), b.column(0).to_numpy(), np.array(b.column(2).to_pylist(), object)
                for one in dict.fromkeys(groups.tolist()):
                    own = np.flatnonzero(groups == one)
                    for at in range(0, len(ids), STEP):
                        scores = x[own] @ q[at : at + STEP].T
                        row, column = best_rows(scores, names[own], k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + column]), pa.array(names[own][row]), pa.array([one] * len(row), pa.string()), pa.array(scores[row, column])], ["query_id", key, group, "score"])

        return vectors.select(key, "embedding", group).mapInArrow(run, schema)

    found = _union([visit(*block) for block in _query_blocks(queries)], vectors, schema)
    order = Window.partitionBy("query_id", group).orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bounds(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, lo, hi): the least and the largest score of each query over all vectors, without a row for each pair."""
    schema = "query_id bigint, lo double, hi double"

    def visit(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            for b in batches:
                x = matrix(b.column(0))
                for at in range(0, len(ids) if b.num_rows else 0, STEP):
                    scores, part = x @ q[at : at + STEP].T, slice(at, at + STEP)
                    low[part], high[part] = np.minimum(low[part], scores.min(0)), np.maximum(high[part], scores.max(0))
            if len(ids) and high[0] > -np.inf:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low), pa.array(high)], ["query_id", "lo", "hi"])

        return vectors.select("embedding").mapInArrow(run, schema)

    return _union([visit(*block) for block in _query_blocks(queries)], vectors, schema).groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def cell_count(n: int) -> int:
    return max(8, int(math.sqrt(n)))


def train_cells(vectors: DataFrame, cells: int | None = None, seed: int = 11, sample: int = 50_000) -> list[list[float]]:
    """Centroids by k-means on at most `sample` vectors, those with the least hashed keys."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    key = vectors.columns[0]
    n = vectors.count()
    drawn = vectors.orderBy(F.xxhash64(key), key).limit(sample)
    model = KMeans(k=min(cells or cell_count(n), max(2, n)), seed=seed, featuresCol="v").fit(drawn.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    return [c.tolist() for c in model.clusterCenters()]


def nearest_cells(rows: DataFrame, centres: list[list[float]], probes: int) -> DataFrame:
    """Adds cells: the numbers of the nearest centroids."""
    c = np.array(centres)

    @F.pandas_udf("array<int>")
    def run(part: pd.Series) -> pd.Series:
        x = np.array(part.tolist(), np.float64).reshape(len(part), -1)
        far = (c * c).sum(1)[None, :] - 2 * x @ c.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return rows.withColumn("cells", run(F.col("embedding")))


@dataclass
class CellIndex:
    """Vectors dealt to cells: centroids, the radius of each cell (-inf: empty) and the table (key, embedding, cell)."""

    centres: np.ndarray
    radius: np.ndarray
    placed: DataFrame


def wants_cells(n: int, forced: bool | None = None) -> bool:
    """Whether cells pay: from CELLS_FROM vectors on, or when forced, but never for fewer than LEAST_VECTORS."""
    return (n >= CELLS_FROM if forced is None else forced) and n >= LEAST_VECTORS


def write_cells(vectors: DataFrame, path: str, centres: list[list[float]] | None = None) -> CellIndex:
    """Trains cells, writes the vectors sorted by cell and a row for each cell, and reads the index back."""
    spark, key = vectors.sparkSession, vectors.columns[0]
    centres = np.array(centres or train_cells(vectors.select(key, "embedding")), np.float64)
    placed = nearest_cells(vectors.select(key, "embedding"), centres.tolist(), 1).select(key, "embedding", F.col("cells")[0].alias("cell"))
    placed.repartitionByRange("cell", key).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/cells")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(centres), -1.0)
        for b in batches:
            if b.num_rows:
                cell = b.column(1).to_numpy()
                np.maximum.at(far, cell, np.linalg.norm(matrix(b.column(0)) - centres[cell], axis=1))
        held = np.flatnonzero(far >= 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(far[held])], ["cell", "radius"])

    radius = spark.read.parquet(f"{path}/cells").select("embedding", "cell").mapInArrow(reach, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius"))
    rows = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    rows.join(radius, "cell", "left").write.mode("overwrite").parquet(f"{path}/centres")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # a row a cell
    return CellIndex(np.array([r.centre for r in rows]), np.array([-np.inf if r.radius is None else r.radius for r in rows]), spark.read.parquet(f"{path}/cells"))


def cell_topk(index: CellIndex | DataFrame, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """(query_id, key, score, rank): exact, over an index, or over vectors that are dealt to cells first. The nearest `probes` cells of a query give a k-th score; then every cell is visited
    whose best possible score, that of its centroid plus its radius times the query's length, reaches that score."""
    if not isinstance(index, CellIndex):
        index = write_cells(index, new_path(index.sparkSession, "cells"))
    c, key = index.centres, index.placed.columns[0]
    schema = f"query_id bigint, {key} bigint, score double"

    def visit(ids: np.ndarray, q: np.ndarray, wanted: np.ndarray) -> DataFrame:
        """The best k of each query of a block among the cells it wants (cells by queries), best k of each batch first."""
        asked_cells = np.flatnonzero(wanted.any(1)).tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, cell, x = b.column(0).to_numpy(), b.column(2).to_numpy(), matrix(b.column(1))
                for one in np.unique(cell):
                    at, asked = np.flatnonzero(cell == one), np.flatnonzero(wanted[one])
                    for part in range(0, len(asked), STEP):
                        some = asked[part : part + STEP]
                        scores = x[at] @ q[some].T
                        row, column = best_rows(scores, names[at], k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some[column]]), pa.array(names[at][row]), pa.array(scores[row, column])], ["query_id", key, "score"])

        held = index.placed if len(asked_cells) == len(c) else index.placed.where(F.col("cell").isin(asked_cells))
        return top(held.mapInArrow(run, schema), k, "score", key)

    out = []
    for ids, q in _query_blocks(queries):
        far = (c * c).sum(1)[:, None] - 2 * c @ q.T
        near = np.zeros(far.shape, bool)
        np.put_along_axis(near, np.argsort(far, axis=0, kind="stable")[:probes], True, 0)
        least = {r.query_id: r.score for r in visit(ids, q, near).where(F.col("rank") == k).collect()}  # a row a query of the block
        bound = c @ q.T + index.radius[:, None] * np.linalg.norm(q, axis=1)
        out.append(visit(ids, q, bound >= np.array([least.get(i, -np.inf) for i in ids.tolist()]) - 1e-8))
    return _union(out, index.placed, f"{schema}, rank int")


def search(vectors: DataFrame, queries: DataFrame, k: int, path: str, forced: bool | None = None) -> DataFrame:
    """The best k of each query: through cells kept under path where there are enough vectors, else by visiting all."""
    if wants_cells(vectors.count(), forced):
        return cell_topk(write_cells(vectors, path), queries, k)
    return batch_topk(vectors, queries, k, vectors.columns[0])


def appended(vectors: DataFrame, rows: DataFrame, encoder=None, key: str = "chunk_id") -> DataFrame:
    """Vectors of all rows (key, text): those at hand are kept, and only rows without one are encoded."""
    new = rows.select(key, "text").join(vectors.select(key), key, "left_anti")
    return vectors.select(key, "embedding").unionByName(encode(new, encoder).select(key, "embedding"))


def require_aligned(rows: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The vectors, if there is exactly one for each row."""
    if not aligned(rows, vectors, key):
        raise ValueError("vectors and chunks don't belong together: some have no counterpart")
    return vectors


def aligned(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether both sides have the same keys."""
    one_sided = left.select(key).withColumn("l", F.lit(1)).join(right.select(key).withColumn("r", F.lit(1)), key, "full_outer")
    return one_sided.where("l is null or r is null").isEmpty()
