"""Intents of a query, the fields they ask for, and the personas that read them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwell.functions import lists
from ledgerwell.functions.text import normalise

_ORDER = list(dict.fromkeys(i for i, _, _ in lists.INTENT_RULES))


def intents(query: Column) -> Column:
    """Map of intent to its share of all matched weights, 4 decimals; empty where no rule matches. Patterns are literals."""
    q = F.coalesce(query, F.lit(""))
    score = F.array(*(F.struct(F.lit(name).alias("intent"), sum((F.when(q.rlike("(?i)" + p), w).otherwise(0.0) for i, w, p in lists.INTENT_RULES if i == name), F.lit(0.0)).alias("w")) for name in _ORDER))

    def shares(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x["w"])
        return F.map_from_entries(F.transform(F.filter(s, lambda x: x["w"] > 0), lambda x: F.struct(x["intent"], F.round(x["w"] / total, 4))))

    return F.transform(F.array(score), shares)[0]


def intent_rows(queries: DataFrame) -> DataFrame:
    """(query_id, intent, confidence) for query_id, query."""
    return queries.select("query_id", F.explode(intents(F.col("query"))).alias("intent", "confidence"))


def top_intent(distribution: Column) -> Column:
    """The largest intent, ties by rule order; null for an empty distribution."""
    order = F.array(*map(F.lit, _ORDER))
    ranked = F.transform(F.map_entries(distribution), lambda e: F.struct((-e["value"]).alias("w"), F.array_position(order, e["key"]).alias("o"), e["key"].alias("k")))
    return F.array_min(ranked)["k"]


def plan(queries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(query_id, plan): what is known of a query before it is answered; outcomes has query_id, matched and unknown."""
    q = F.col("query")
    found = queries.join(outcomes.select("query_id", "matched", "unknown"), "query_id", "left")
    none = F.array().cast("array<string>")
    entities = F.coalesce("matched", none)
    return found.select("query_id", F.struct(q.alias("raw"), normalise(q).alias("normalised"), entities.alias("entities"), F.coalesce("unknown", none).alias("unknown"), intents(q).alias("intents"), (F.size(entities) > 1).alias("is_multi_drug")).alias("plan"))


@dataclass(frozen=True)
class Persona:
    id: str
    k: int
    allowed: frozenset[str] | None = None
    blocked: frozenset[str] = frozenset()
    field_boost: float = 0.20
    plain: bool = False
    headings: tuple[str, ...] = ()

    def fetch_k(self, k: int | None = None) -> int:
        """How many candidates to ask for, as a field policy drops some."""
        k = k or self.k
        return k if self.allowed is None and not self.blocked else min(5 * k, 60)

    def admits(self, field: Column, origin: Column) -> Column:
        """Uploads always; else not blocked, and allowed where there is a list."""
        own = ~field.isin(*self.blocked) if self.blocked else F.lit(True)
        return (origin != "drug-corpus") | (own & (field.isin(*self.allowed) if self.allowed is not None else F.lit(True)))

    def diff(self, other: Persona) -> dict:
        return {k: (v, getattr(other, k)) for k, v in vars(self).items() if k != "id" and v != getattr(other, k)}


PATIENT = Persona("patient", 4, frozenset({"indications", "side_effects", "contraindications", "description"}), frozenset({"mechanism", "pharmacokinetics", "clinical_pharmacology"}), plain=True)
PRACTITIONER = Persona("practitioner", 8, headings=lists.CLINICAL_HEADINGS)


def field_weights(queries: DataFrame, persona: Persona | None = None) -> DataFrame:
    """(query_id, field, weight): confidences times the fields of each intent, within the persona's policy."""
    wanted = queries.sparkSession.createDataFrame(lists.INTENT_FIELDS, "intent string, field string, weight double")
    rows = intent_rows(queries).join(wanted, "intent")
    if persona:
        rows = rows.where(persona.admits(F.col("field"), F.lit("drug-corpus")))
    return rows.groupBy("query_id", "field").agg(F.sum(F.col("confidence") * F.col("weight")).alias("weight"))


def select_for(persona: Persona, ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks a persona may read: policy, then the best by score, then packing order among those; adds position."""
    from pyspark.sql import Window

    per = Window.partitionBy("query_id")
    kept = ranked.where(persona.admits(F.col("field"), F.col("origin")))
    kept = kept.withColumn("by_score", F.row_number().over(per.orderBy(F.desc(F.round("score", 9)), "chunk_id"))).where(F.col("by_score") <= (limit or persona.k))
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in lists.PLAIN_ORDER.items() for x in kv)), F.col("field")), F.lit(9)) if persona.plain else F.lit(0)
    return kept.withColumn("position", F.row_number().over(per.orderBy(place, "by_score"))).drop("by_score")


def dropped_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, dropped): fields that a persona's policy took away, sorted."""
    a = before.groupBy("query_id").agg(F.collect_set("field").alias("had"))
    b = after.groupBy("query_id").agg(F.collect_set("field").alias("has"))
    return a.join(b, "query_id", "left").select("query_id", F.array_sort(F.array_except("had", F.coalesce("has", F.array().cast("array<string>")))).alias("dropped"))
