"""Quality rules with host verdicts.

Rules are judged per document; failures are counted per host (the source column), each host's failure rate is shrunk by a
beta prior fitted to all hosts, and a host with a shrunk rate far above the prior loses its documents. The limit is SPREADS
standard deviations of the prior above its mean, held between LEAST and MOST: a host that fails a rule on fewer than a quarter
of its documents is not rejected, however alike the others are, and one that fails it on more than half always is.

Null text has no words; a null source is a host of its own; repeated rows count each time; an empty table gives an empty
result; other columns are ignored. Long texts are one row: every step on words is linear, but for the sort of the repeated
case, which is n log n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.common import table, words, written

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "lines")
#: The limit of a rule: the prior's mean and so many of its standard deviations, within two bounds.
SPREADS, LEAST, MOST = 3.0, 0.25, 0.5
#: Documents that the prior counts for, at most.
STRENGTH = 10_000.0


def document_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for each row of docs.

    3-word windows are compared by 64-bit hashes inside one text. Where all differ, nothing is sorted; else sorted (hash,
    place) pairs put equal windows side by side, and each place found covers up to three words beyond the one before.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    out = docs.select("doc_id", "source", text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    n = F.size("w")
    hashes = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    out = out.select(
        "doc_id",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    twice = F.size(F.array_distinct("h")) < F.size("h")
    out = out.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda p, k: (F.get("s", k - 1)["x"].eqNullSafe(p["x"])) | (F.get("s", k + 1)["x"].eqNullSafe(p["x"]))
    out = out.withColumn("places", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(F.filter("s", same), lambda p: p["i"]))))
    gap = lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("places", k - 1)))
    repeat = F.when(F.col("places").isNotNull(), F.aggregate(F.transform("places", gap), F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    return out.withColumn("n_repeat_words", repeat).drop("h", "s", "places")


def rule_failures(metrics: DataFrame) -> DataFrame:
    """Adds fails_<rule> flags and base_failed."""
    return (
        metrics.withColumn("fails_short", F.col("n_words") < 50)
        .withColumn("fails_repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        .withColumn("fails_symbols", 4 * F.col("n_symbols") > F.col("word_chars"))
        .withColumn("fails_lines", 2 * F.col("n_dup_lines") > F.col("n_lines"))
        .withColumn("base_failed", F.col("fails_short") | F.col("fails_repeats"))
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """source, n_docs, rate_<rule> (shrunk), limit_<rule> and rejected for each host.

    The prior's mean is the share of all documents that fail. Its strength follows from the spread of the hosts' rates beyond
    what the chance of so many documents gives (analysis of variance), between 1 and STRENGTH documents; hosts that differ by
    chance only, or a single host, get the largest.
    """
    hosts = judged.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"bad_{r}") for r in RULES))
    n, squares = F.col("n_docs").cast("double"), lambda r: F.col(f"bad_{r}") * F.col(f"bad_{r}") / F.col("n_docs")
    prior = hosts.agg(F.sum(n).alias("n_all"), F.sum(n * n).alias("n_squares"), F.count("*").alias("n_hosts"), *(F.sum(f"bad_{r}").alias(f"all_{r}") for r in RULES), *(F.sum(squares(r)).alias(f"between_{r}") for r in RULES))
    both = hosts.crossJoin(prior)  # one row of sums
    free = F.col("n_hosts") - 1
    for r in RULES:
        mean = F.col(f"all_{r}") / F.col("n_all")
        chance = mean * (1 - mean)
        beyond = (F.col(f"between_{r}") - F.col("n_all") * mean * mean) - free * chance
        room = F.col("n_all") - F.col("n_squares") / F.col("n_all") - free
        strength = F.when((chance > 0) & (beyond > 1e-9) & (room > 0), F.least(F.lit(STRENGTH), F.greatest(F.lit(1.0), chance * room / beyond - 1))).otherwise(STRENGTH)
        both = both.withColumn(f"strength_{r}", strength).withColumn(f"rate_{r}", (F.col(f"bad_{r}") + F.col(f"strength_{r}") * mean) / (F.col("n_docs") + F.col(f"strength_{r}")))
        both = both.withColumn(f"limit_{r}", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), mean + SPREADS * F.sqrt(chance / (F.col(f"strength_{r}") + 1)))))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"rate_{r}") > F.col(f"limit_{r}"))
    return both.select("source", "n_docs", *(f"rate_{r}" for r in RULES), *(f"limit_{r}" for r in RULES), rejected.alias("rejected"))


def quality(docs: DataFrame) -> DataFrame:
    """The metrics, flags, host verdict and kept for each row of docs."""
    judged = rule_failures(written(document_metrics(docs), "quality"))
    hosts = host_verdicts(judged).select(F.col("source").alias("host"), "rejected", *(f"rate_{r}" for r in RULES))
    return judged.join(hosts, judged["source"].eqNullSafe(hosts["host"])).drop("host").withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(table(spark, sf_dir, "documents")).select(*names)


_SUMS = ",\n".join(f"sum(bad_{r}) OVER () / n_all AS mean_{r}, sum(bad_{r} * bad_{r} / n_docs) OVER () AS between_{r}" for r in RULES)
_BEYOND = ",\n".join(f"between_{r} - n_all * mean_{r} * mean_{r} - free * mean_{r} * (1 - mean_{r}) AS beyond_{r}, mean_{r} * (1 - mean_{r}) AS chance_{r}" for r in RULES)
_STRENGTH = ",\n".join(f"CASE WHEN chance_{r} > 0 AND beyond_{r} > 1e-9 AND n_all - n_squares / n_all - free > 0 THEN least({STRENGTH}, greatest(1.0, chance_{r} * (n_all - n_squares / n_all - free) / beyond_{r} - 1)) ELSE {STRENGTH} END AS s_{r}" for r in RULES)
_REJECTED = " OR ".join(f"(bad_{r} + s_{r} * mean_{r}) / (n_docs + s_{r}) > greatest({LEAST}, least({MOST}, mean_{r} + {SPREADS} * sqrt(chance_{r} / (s_{r} + 1))))" for r in RULES)
OP5_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), keyed AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM tri
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE c > 1) GROUP BY 1
), ln AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), m AS (
  SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, coalesce(ln.n, 0) AS n_lines,
    coalesce(ln.n - ln.d, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
), j AS (
  SELECT *, n_words < 50 AS fails_short, 100 * n_repeat_words > 50 * n_words AS fails_repeats,
    4 * n_symbols > word_chars AS fails_symbols, 2 * n_dup_lines > n_lines AS fails_lines FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n_docs, {", ".join(f"sum(fails_{r}::INT)::DOUBLE AS bad_{r}" for r in RULES)} FROM j GROUP BY 1
), n AS (SELECT *, sum(n_docs) OVER () AS n_all, sum(n_docs * n_docs) OVER () AS n_squares, count(*) OVER () - 1 AS free FROM h),
p AS (SELECT *, {_SUMS} FROM n), b AS (SELECT *, {_BEYOND} FROM p), s AS (SELECT *, {_STRENGTH} FROM b),
v AS (SELECT source, {_REJECTED} AS rejected FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (fails_short OR fails_repeats) AS base_failed,
  NOT (fails_short OR fails_repeats) AND NOT rejected AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
