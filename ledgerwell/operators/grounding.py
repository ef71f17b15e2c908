"""Which known entities a query names, and which names are unknown."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions import text


def vocabulary(chunks: DataFrame, column: str = "drug") -> DataFrame:
    """(token) of all identity tokens."""
    return chunks.select(F.explode(text.identity_tokens(F.col(column))).alias("token")).distinct()


def chunk_tokens(chunks: DataFrame, column: str = "drug") -> DataFrame:
    return chunks.select("chunk_id", F.explode(text.identity_tokens(F.col(column))).alias("token"))


def standalone_names(records: DataFrame, column: str = "name") -> DataFrame:
    """(token, name) of names that have one identity token: the shortest, then the first in order."""
    name = F.trim(column)
    rows = records.where(name != "").select(name.alias("name"), text.identity_tokens(name).alias("t")).where(F.size("t") == 1)
    return rows.groupBy(F.col("t")[0].alias("token")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))


def brand_map(brands: DataFrame, records: DataFrame, column: str = "name") -> DataFrame:
    """(brand, generic, record, kind) of (brand, generic): resolve, combination or absent, by the generic's first word."""
    head = F.split("generic", " ")[0]
    single = standalone_names(records, column).select(F.col("token").alias("head"), F.col("name").alias("record"))
    anywhere = vocabulary(records, column).select(F.col("token").alias("head"), F.lit(True).alias("known"))
    rows = brands.withColumn("head", head).join(single, "head", "left").join(anywhere, "head", "left")
    kind = F.when(F.col("record").isNotNull(), "resolve").when(F.col("known"), "combination").otherwise("absent")
    return rows.select("brand", F.when(F.col("record").isNotNull(), F.col("head")).otherwise(F.col("generic")).alias("generic"), "record", kind.alias("kind"))


def same_map(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def ground(queries: DataFrame, vocab: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """(query_id, term, position, kind, entity, note): every salient term as matched, alias or unknown.

    The vocabulary goes first, then brands whose generic is in the vocabulary; a brand that isn't resolved stays unknown and
    carries its note.
    """
    rows = queries.select("query_id", F.posexplode(text.salient_terms(F.col("query"))).alias("position", "term"))
    known = vocab.select(F.col("token").alias("term"), F.lit(True).alias("known"))
    rows = rows.join(known, "term", "left")
    if brands is None:
        return rows.select("query_id", "term", "position", F.when(F.col("known"), "matched").otherwise("unknown").alias("kind"), F.when(F.col("known"), F.col("term")).alias("entity"), F.lit(None).cast("string").alias("note"))
    held = vocab.select(F.col("token").alias("generic"), F.lit(True).alias("held"))
    usable = brands.join(held, "generic", "left").select(F.col("brand").alias("term"), "generic", (F.col("kind") == "resolve").alias("resolves"), F.coalesce("held", F.lit(False)).alias("held"), F.concat_ws(": ", "generic", "kind").alias("reason"))
    rows = rows.join(usable, "term", "left")
    alias = F.col("known").isNull() & F.col("resolves") & F.col("held")
    kind = F.when(F.col("known"), "matched").when(alias, "alias").otherwise("unknown")
    return rows.select("query_id", "term", "position", kind.alias("kind"), F.when(F.col("known"), F.col("term")).when(alias, F.col("generic")).alias("entity"), F.when(F.col("known").isNull() & ~F.coalesce("resolves", F.lit(True)), F.col("reason")).alias("note"))


def outcomes(queries: DataFrame, grounded: DataFrame) -> DataFrame:
    """query_id, query with aliases written out, matched, unknown, aliases, notes; a row for every query."""
    per = grounded.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "unknown", F.col("entity")))).alias("matched"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "unknown", F.struct("position", "term")))), lambda x: x["term"]).alias("unknown"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "alias", F.struct("position", F.col("term").alias("term"), F.col("entity").alias("entity"))))).alias("pairs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("term", "note"))))).alias("notes"),
    )
    none = F.array().cast("array<string>")
    rows = queries.join(per, "query_id", "left").withColumn("matched", F.coalesce("matched", none)).withColumn("unknown", F.coalesce("unknown", none))
    written = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<position:int,term:string,entity:string>>")), F.col("query"), lambda q, p: F.regexp_replace(q, F.concat(F.lit(r"(?i)\b\Q"), p["term"], F.lit(r"\E\b")), p["entity"]))
    aliases = F.map_from_entries(F.transform(F.coalesce("pairs", F.array().cast("array<struct<position:int,term:string,entity:string>>")), lambda p: F.struct(p["term"], p["entity"])))
    return rows.select("query_id", "query", written.alias("rewritten"), "matched", "unknown", aliases.alias("aliases"), "notes")


def _pairs_of(words: DataFrame, column: str) -> DataFrame:
    """(word, pair, nth, n): the neighbouring characters of each padded word, the nth of equal ones, and how many a word has."""
    padded = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    each = F.transform(F.sequence(F.lit(1), F.length(column) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    rows = words.select(F.col(column).alias("word"), (F.length(column) + 1).alias("n"), F.explode(each).alias("pair"))
    counted = rows.groupBy("word", "n", "pair").agg(F.count("*").alias("times"))
    return counted.select("word", "n", "pair", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))


def candidates(terms: DataFrame, vocab: DataFrame, cutoff: float) -> DataFrame:
    """(term, token) pairs that could reach the cutoff, by a filter on the rarest character pairs of each word.

    A ratio r of words with a and b characters needs m >= r (a + b) / 2 characters in common blocks. The a + b - 2 m others end at
    most as many blocks, so padded words share at least 3 m - (a + b) + 1 character pairs; and as m is at most the shorter length,
    the longer is at most 2 / r - 1 times the shorter. If a word with n pairs shares at least t with another, then one of its
    n - t + 1 rarest pairs is among the other's; so only these are joined, by an order that both sides share. A pair that the
    words share at places i and j of that order leaves room for so many more, which must be enough, as must their common letters.
    """
    spread = 2 / cutoff - 1
    needed = lambda both: F.greatest(F.lit(1), F.ceil((1.5 * cutoff - 1) * both + 1 - 1e-9))
    least = lambda size: needed(size + size / spread)
    known = _pairs_of(vocab.select("token").distinct(), "token")
    asked = _pairs_of(terms.select("term").distinct(), "term")
    held = known.groupBy("pair", "nth").agg(F.count("*").alias("df"))

    def rarest(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "pair", "nth")
        ranked = rows.join(held, ["pair", "nth"], "left").withColumn("at", F.row_number().over(order))
        return ranked.where(F.col("at") <= F.col("n") - least(F.col("n") - 1) + 1).select("word", "n", "at", "pair", "nth")

    left = rarest(asked).select(F.col("word").alias("term"), F.col("n").alias("n_term"), F.col("at").alias("at_term"), "pair", "nth")
    right = rarest(known).select(F.col("word").alias("token"), F.col("n").alias("n_token"), F.col("at").alias("at_token"), "pair", "nth")
    both = F.col("n_term") + F.col("n_token") - 2
    fits = F.greatest("n_term", "n_token") - 1 <= spread * (F.least("n_term", "n_token") - 1) + 1e-9
    room = 1 + F.least(F.col("n_term") - F.col("at_term"), F.col("n_token") - F.col("at_token")) >= needed(both)
    near = left.join(right, ["pair", "nth"]).where(fits & room).select("term", "token").distinct()
    letters = F.array_distinct(F.split("token", ""))
    times = lambda word, c: F.length(word) - F.length(F.replace(F.col(word), c, F.lit("")))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times("term", c), times("token", c)))
    return near.where(2 * common >= cutoff * (F.length("term") + F.length("token")))


def suggestions(unknown: DataFrame, vocab: DataFrame, cutoff: float = 0.82) -> DataFrame:
    """(term, match, ratio): the nearest vocabulary word of each distinct unknown term, by sequence ratio; above two thirds the
    candidates come from rare character pairs, below that all words of a fitting length would qualify, which is refused."""
    if cutoff <= 2 / 3:
        raise ValueError("the cutoff must be above two thirds")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)])

    scored = candidates(unknown, vocab, cutoff).withColumn("ratio", ratio("term", "token")).where(F.col("ratio") >= cutoff)
    return scored.groupBy("term").agg(F.max_by("token", F.struct("ratio", "token")).alias("match"), F.max("ratio").alias("ratio"))
