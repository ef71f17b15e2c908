"""Mixing sources to target word counts by pivotal dependent rounding.

Every document of a source wants target / source_size copies, a whole part plus a fraction. Two documents with fractions
duel: word mass moves from one to the other, in a random direction that keeps each one's expected copies, until one
fraction is 0 or 1. The sum of fraction * size never changes, so a source ends within one document of its target. Duels
run inside small nodes; what is left of a node goes up a tree of nodes, a grouped fold at each level. The few documents with
a large share of their source duel first, and what the last of them gains or owes by rounding is spread over the fractions
of the others, so that a source ends within half a small document of its target.

Null text counts no words; a null source is a source of its own, ordered last; repeated rows are rounded one by one, and
those of one row that is repeated very often are dealt over tasks; a long text is counted whole, in one expression; ties are
drawn by hashes of id, number of the copy and size; an empty table gives an empty result; other columns are ignored. The
windows of the targets run over one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.common import let, table, word_count, written

#: Documents to a node of the tree.
FAN = 64
#: Documents with more than 1 / n of their source's words are settled before the others, for each n in turn.
LARGE = (50, 200)
#: Copies of one row that a task numbers; rows with more are dealt over tasks.
COPIES = 10_000
ITEM = "struct<doc_id:bigint,nth:bigint,size:bigint,p:double>"
DECIDED = "struct<doc_id:bigint,nth:bigint,size:bigint,picked:int>"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Adds target to (source, source_size, ...): shares of all words by weight, filled up to cap * source_size.

    With caps c and weights w, the filled shares are min(level * w, c) for the one level at which they add up to the total;
    sorted by c / w, the level is the first whose own share stays below its cap. The windows run over one row a source.
    """
    everything = Window.partitionBy()
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", cap * F.col("source_size")).withColumn("room", F.col("top") / F.col("w"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("at", F.row_number().over(by_room))
    found = F.min(F.when(F.col("level") <= F.col("room"), F.struct("at", "level"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("top").cast("double"), F.coalesce(found["level"] * F.col("w"), F.col("top").cast("double")))).drop("w", "top", "room", "level", "at")


def _draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _decided(item: Column, picked: Column) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["nth"].alias("nth"), item["size"].alias("size"), picked.cast("int").alias("picked"))


def _with_p(item: Column, p: Column) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["nth"].alias("nth"), item["size"].alias("size"), p.alias("p"))


def _duel(seed: int, a: Column, b: Column) -> Column:
    """struct(done, rest): after mass moved between a and b, the decided ones, and the one that stays fractional, or null."""
    mass = F.struct(F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]).alias("to_a"), F.least((1 - b["p"]) * b["size"], a["p"] * a["size"]).alias("to_b"))

    def moved(m: Column) -> Column:
        to_a = _draw(seed, a["doc_id"], a["nth"], b["doc_id"], b["nth"]) * (m["to_a"] + m["to_b"]) < m["to_b"]
        pa = F.when(to_a, F.when((1 - a["p"]) * a["size"] <= m["to_a"], 1.0).otherwise(a["p"] + m["to_a"] / a["size"])).otherwise(F.when(a["p"] * a["size"] <= m["to_b"], 0.0).otherwise(a["p"] - m["to_b"] / a["size"]))
        pb = F.when(to_a, F.when(b["p"] * b["size"] <= m["to_a"], 0.0).otherwise(b["p"] - m["to_a"] / b["size"])).otherwise(F.when((1 - b["p"]) * b["size"] <= m["to_b"], 1.0).otherwise(b["p"] + m["to_b"] / b["size"]))
        return F.struct(pa.alias("pa"), pb.alias("pb"))

    def settled(p: Column) -> Column:
        whole_a, whole_b = (p["pa"] <= 0) | (p["pa"] >= 1), (p["pb"] <= 0) | (p["pb"] >= 1)
        done = F.when(whole_a & whole_b, F.array(_decided(a, p["pa"]), _decided(b, p["pb"]))).when(whole_a, F.array(_decided(a, p["pa"]))).otherwise(F.array(_decided(b, p["pb"])))
        rest = F.when(whole_a & whole_b, F.lit(None).cast(ITEM)).when(whole_a, _with_p(b, p["pb"])).otherwise(_with_p(a, p["pa"]))
        return F.struct(done.alias("done"), rest.alias("rest"))

    return let(let(mass, moved), settled)


def _fold(seed: int, items: Column) -> Column:
    """Duels through an array of fractional items: struct(done, rest)."""

    def step(state: Column, item: Column) -> Column:
        both = let(_duel(seed, state["rest"], item), lambda d: F.struct(F.concat(state["done"], d["done"]).alias("done"), d["rest"].alias("rest")))
        return F.when(state["rest"].isNull(), F.struct(state["done"].alias("done"), item.alias("rest"))).otherwise(both)

    start = F.struct(F.array().cast(f"array<{DECIDED}>").alias("done"), F.lit(None).cast(ITEM).alias("rest"))
    return F.aggregate(items, start, step)


def _folded(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """One row for each key: its items after their duels, in an order fixed by the seed."""
    order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "item.doc_id", "item.nth").alias("h"), "item")))
    return rows.groupBy(*key).agg(order.alias("items")).select(*key, _fold(seed, F.transform("items", lambda x: x["item"])).alias("out"))


def _settled(folded: DataFrame) -> DataFrame:
    return folded.select("source", "source_size", "target", "whole", F.explode("out.done").alias("x")).select("x.doc_id", "source", "x.size", "source_size", "target", (F.col("whole") + F.col("x.picked")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 20240607) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Rows that agree in id, source and size are counted first, so that a repeated id can't fill a node.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = source_targets(per_source, weights, cap)
    targets = written(targets.withColumn("leaves", F.ceil(F.col("n_docs") / FAN)), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(rate)
    counted = (
        sized.alias("d")
        .join(targets.alias("t"), F.expr("d.source <=> t.source"))
        .select("d.doc_id", "d.source", "d.size", "n", "source_size", "target", "leaves", F.when(F.abs(rate - near) < 1e-9, near).otherwise(rate).alias("rate"))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("p", F.col("rate") - F.floor("rate"))
    )
    few = counted.where(F.col("n") <= COPIES).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = counted.where(F.col("n") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    begin = F.col("block") * COPIES
    many = block.repartition(parts, "doc_id", "size", "block").withColumn("nth", F.explode(F.sequence(begin + 1, F.least(F.col("n"), begin + COPIES)))).drop("block")
    rows = few.unionByName(many)
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    closed = rows.where(~open_).select("doc_id", "source", "size", "source_size", "target", F.col("whole").alias("copies"))
    of = ["source", "source_size", "target", "whole"]
    item = F.struct("doc_id", "nth", "size", "p").cast(ITEM)
    parts, left, rest = [closed], rows.where(open_), F.col("out.rest")
    for n in LARGE:
        large = F.col("size") * n > F.col("source_size")
        first = written(_folded(left.where(large).select(*of, item.alias("item")), of, seed - n), f"mix-large{n}")
        picked = F.round(rest["p"]).cast("int")  # one document a source, to the nearer side; the others make up for it
        undecided = first.where("out.rest is not null")
        parts += [_settled(first), undecided.select(rest["doc_id"].alias("doc_id"), "source", rest["size"].alias("size"), "source_size", "target", (F.col("whole") + picked).alias("copies"))]
        owed = undecided.select("source", ((rest["p"] - picked) * rest["size"]).alias("owed"))
        left = left.where(~large)
        room = left.groupBy("source").agg(F.sum("size").alias("room"))
        shift = room.alias("r").join(owed.alias("o"), F.expr("r.source <=> o.source"), "left").select(F.col("r.source").alias("of"), (F.coalesce("owed", F.lit(0.0)) / F.col("room")).alias("shift"))
        left = left.join(shift, F.expr("source <=> of")).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("shift")))).drop("of", "shift")
        left = written(left, f"mix-left{n}")
    leaf = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "nth"), F.col("leaves"))
    level = left.select(*of, leaf.alias("node"), item.alias("item"))
    most = targets.agg(F.max("leaves")).first()[0] or 1
    for k in range(max(1, math.ceil(math.log(most, FAN) - 1e-9) + 1)):
        folded = written(_folded(level, [*of, "node"], seed + k), f"mix-level{k}")
        parts.append(_settled(folded))
        level = folded.where("out.rest is not null").select("source", "source_size", "target", "whole", F.floor(F.col("node") / FAN).alias("node"), F.col("out.rest").alias("item"))
        most = -(-most // FAN)
    last = F.round("item.p").cast("long")
    parts.append(level.select("item.doc_id", "source", "item.size", "source_size", "target", (F.col("whole") + last).alias("copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
