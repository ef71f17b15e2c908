"""Connected components of a link table, by alternating star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwell.llm.common import written

#: Links that a task is given; small link tables are dealt to fewer tasks than the session's shuffles.
LINKS = 100_000


def _tasks(edges: DataFrame, n: int) -> int:
    return max(1, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LINKS)))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest node around it. One exchange: the links meet by node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(tasks, "a")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low.hint("merge"), "a").where(F.col("b") > F.col("a")).select("b", "low").where("low < b").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked with the smallest of them; edges run from larger to smaller."""
    own = edges.repartition(tasks, "a").distinct()
    low = own.groupBy("a").agg(F.min("b").alias("low"))
    moved = own.join(low.hint("merge"), "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).repartition(tasks, "a").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that a link (a, b) names; root is the smallest node that can be reached.

    Both steps keep the components and shrink distances; when a round changes nothing, every edge runs to its root. Each
    round is written to the shared folder. Nulls and self links are ignored; no links give no rows.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = written(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state()
    for _ in range(rounds):
        tasks = _tasks(edges, 2 * before[0])
        edges = written(_small_star(_large_star(edges, tasks), tasks), "stars")
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
