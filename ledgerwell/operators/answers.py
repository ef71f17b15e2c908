"""Context, prompts, quoted answers, refusals, verification and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.config import DISCLAIMER
from ledgerwell.functions import lists, text

RULES = (
    "Answer only from the numbered sources below. Cite each statement as [Source N]. Keep numbers and negations as they are. "
    "Say so when the sources don't answer the question. Close with: " + DISCLAIMER
)
QUOTED = "_(No model is connected; these are the most relevant passages.)_"
MISSING = "*Not addressed in the retrieved sections.*"
ADVISORY = "> **This is what the label says, not advice for you.** Ask your doctor or pharmacist before any change."
ESCALATION = "**Who to ask:** your doctor or pharmacist knows your history."
SCREENS = {
    "red_flag": "This may be an emergency. Call your local emergency number now. No search was made.",
    "medication_change": "Whether to change how you take a medicine is for your doctor or pharmacist to decide.",
    "interaction": "Whether two medicines are safe together is for the interaction checker and your pharmacist.",
}


def packed(results: DataFrame, max_chars: int = 12_000, position: str = "rank") -> DataFrame:
    """(query_id, context, n_sources): whole numbered blocks while they fit; the first one always."""
    block = F.concat(F.format_string("[Source %d] (drug=%s, field=%s, score=%.3f)\n", F.col(position), "drug", "field", "score"), "text")
    rows = results.withColumn("block", block)
    upto = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where((F.col(position) == 1) | (F.col("upto") <= max_chars))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "block"))), lambda x: x["block"])
    return rows.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"), F.count("*").alias("n_sources"))


def prompt(context: Column, query: Column, rules: str = RULES) -> Column:
    return F.concat(F.lit(f"{rules}\n\n---\nCONTEXT:\n"), context, F.lit("\n---\n\nQUESTION: "), query, F.lit("\n\nANSWER (with [Source N] citations):"))


def quoted(results: DataFrame, position: str = "rank") -> DataFrame:
    """(query_id, answer): the passages themselves, headed and cited."""
    line = F.concat(F.format_string("**[Source %d] %s — %s**  \n", F.col(position), "title", F.replace("field", F.lit("_"), F.lit(" "))), text.snippet(F.trim(text.without_prefix(F.col("text")))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("l")))), lambda x: x["l"])
    return results.groupBy("query_id").agg(F.concat(F.lit(QUOTED + "\n\n"), F.array_join(lines, "\n\n"), F.lit("\n\n" + DISCLAIMER)).alias("answer"))


def explained(notes: Column) -> Column:
    """Of notes (brand -> `generic: kind`), a sentence for each brand that is known but not resolved; null without any."""

    def line(e: Column) -> Column:
        generic, why = F.regexp_extract(e["value"], "^(.*): ", 1), F.regexp_extract(e["value"], ": ([a-z]+)$", 1)
        reason = F.when(why == "combination", F.lit(" is held in combination products alone, which are other medicines.")).otherwise(F.lit(" is not held here."))
        return F.concat(F.lit("**"), F.initcap(e["key"]), F.lit("** is a name of *"), generic, F.lit("*, which"), reason)

    return F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries(notes)), line), "\n\n"), F.lit(""))


def source_ids(results: DataFrame, position: str = "rank") -> DataFrame:
    """(query_id, source_ids): title and field of every source, in order."""
    one = F.struct(F.col(position).alias("p"), F.concat("title", F.lit("·"), "field").alias("id"))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["id"]), "; ").alias("source_ids"))


def refusal(status: Column, unknown: Column, matched: Column, suggestion: Column, notes: Column | None = None) -> Column:
    """Why nothing is answered: notes on brands where there are any, else the nearest known names."""
    names = F.array_join(unknown, ", ")
    said = explained(notes) if notes is not None else F.lit(None).cast("string")
    hint = F.when(said.isNotNull(), F.concat(F.lit("\n\n"), said)).when(suggestion.isNotNull(), F.concat(F.lit("\n\nClosest match: "), suggestion)).otherwise("")
    message = (
        F.when(status == "unknown_entity", F.concat(F.lit("No information on "), names, F.lit(" is held here."), hint))
        .when(status == "no_relevant_context", F.concat(F.coalesce(F.nullif(F.array_join(matched, ", "), F.lit("")), F.lit("That source")), F.lit(" is held here, but nothing relevant enough to this question.")))
        .when(status == "no_entity", F.lit("Please name a drug in the question."))
    )
    return F.concat(message, F.lit("\n\n" + DISCLAIMER))


def verification(answer: Column, context: Column, n_sources: Column) -> Column:
    """struct of citations, invalid, n_sources, has_disclaimer, overlap, grounded."""
    cited = text.citations(answer)
    valid = F.filter(cited, lambda c: (c >= 1) & (c <= n_sources))
    invalid = F.filter(cited, lambda c: (c < 1) | (c > n_sources))
    return F.struct(
        valid.alias("citations"), invalid.alias("invalid"), n_sources.cast("long").alias("n_sources"),
        F.contains(F.lower(answer), F.lit("not medical advice")).alias("has_disclaimer"), text.overlap(answer, context).alias("overlap"),
        ((F.size(valid) > 0) & (F.size(invalid) == 0)).alias("grounded"),
    )


def screen(query: Column, top_intent: Column) -> Column:
    """The first screen a lay query runs into, or null."""
    return F.when(text.is_red_flag(query), "red_flag").when(text.is_medication_change(query), "medication_change").when(top_intent == "interactions", "interaction")


def enforce_plain(answer: Column) -> Column:
    framed = F.when(text.is_dosing_imperative(answer), F.concat(F.rtrim(answer), F.lit("\n\n" + ADVISORY))).otherwise(answer)
    return F.when(F.contains(F.lower(framed), F.lit("doctor or pharmacist")), framed).otherwise(F.concat(F.rtrim(framed), F.lit("\n\n" + ESCALATION)))


def enforce_headings(answer: Column, headings=lists.CLINICAL_HEADINGS) -> Column:
    """Names missing headings, where at least one is there."""
    missing = F.filter(F.array(*map(F.lit, headings)), lambda h: ~F.contains(F.lower(answer), F.lower(h)))
    note = F.concat(F.rtrim(answer), F.lit("\n\n---\n**Not covered by the retrieved sections:** "), F.array_join(missing, " · "), F.lit("\n\n" + MISSING))
    return F.when((F.size(missing) == 0) | (F.size(missing) == len(headings)), answer).otherwise(note)


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds audit rows to the log, which is only ever appended to."""
    rows.write.mode("append").parquet(path)


def export_audit(spark: SparkSession, path: str, to: str) -> None:
    """The log as CSV files with a header, in order of time."""
    spark.read.parquet(path).orderBy("time", "persona", "query").write.mode("overwrite").csv(to, header=True)


def audit_rows(answers: DataFrame) -> DataFrame:
    """Rows for the audit table; the query is redacted on the way in."""
    v = F.col("verification")
    dash = lambda name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("—")) if name in answers.columns else F.lit("—")
    return answers.select(
        "time", "persona", text.redact(F.col("query")).alias("query"), "status", "mode", F.col("n_sources").cast("int").alias("sources"),
        dash("source_ids").alias("source_ids"), dash("provider").alias("provider"), dash("model").alias("model"),
        F.coalesce(F.concat(F.size(v["citations"]).cast("string"), F.lit("/"), v["n_sources"].cast("string")), F.lit("—")).alias("cited"),
        F.coalesce(F.format_string("%.0f%%", v["overlap"] * 100), F.lit("—")).alias("overlap"), F.coalesce(F.when(v["grounded"], "yes").otherwise("no"), F.lit("—")).alias("grounded"),
        F.coalesce(F.nullif(F.array_join("dropped_fields", ", "), F.lit("")), F.lit("—")).alias("withheld_fields"),
    )


def audit_rollup(rows: DataFrame, *by: str) -> DataFrame:
    """Answers, refusals, grounded answers and personas, of all rows or of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("answers"), F.count_if(F.col("status") != "ok").alias("refused"), F.count_if(F.col("grounded") == "yes").alias("grounded"), F.countDistinct("persona").alias("personas"))
