"""Records to documents to chunks, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwell.functions import lists, text
from ledgerwell.session import stored

CORPUS = "drug-corpus"


def documents_from_records(records: DataFrame, fields: tuple[str, ...] = lists.RECORD_FIELDS) -> DataFrame:
    """One document for each filled field of a record, in field order; nameless records and empty fields give none."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("ord"), F.col(f).cast("string").alias("body")) for k, f in enumerate(fields)))
    name, category = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("category", F.lit("")))
    rows = records.where(name != "").select(name.alias("title"), F.when(category == "", "uncategorized").otherwise(category).alias("category"), F.explode(parts).alias("p"))
    body = text.collapse(F.col("p.body"))
    return rows.where(body != "").select(
        F.concat(F.lower("title"), F.lit("::"), F.col("p.field")).alias("doc_id"), "title", F.col("p.field").alias("field"), "category", body.alias("text"), F.lit(CORPUS).alias("origin"),
        F.create_map(F.lit("field_order"), F.col("p.ord").cast("string")).alias("meta"),
    )


def chunk_table(docs: DataFrame, size: int = 90, overlap: int = 25, profile: str = text.DEFAULT_PROFILE) -> DataFrame:
    """Windows of documents (doc_id, title, field, category, text, origin), each under a heading of title and field."""
    cut = docs.select("*", F.posexplode(text.windows(F.col("text"), size, overlap)).alias("win", "piece"))
    full = F.concat("title", F.lit(" — "), "field", F.lit(": "), "piece")
    out = cut.select(
        "doc_id", F.lower("title").alias("drug"), "title", F.lower("category").alias("category"), "field", F.col("win").cast("int").alias("win"),
        full.alias("text"), "origin",
    )
    return out.withColumn("clean", text.cleaned(F.col("text"), profile)).withColumn("word_count", text.word_count(F.col("text")).cast("int"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id, dense in order of (doc_id, win): counts of range partitions give the offsets, so no task ranks all rows.

    The ranges are sampled, so the chunks are cut and stored before, and the dealt rows are stored with their range, which both
    the counts and the rows read. The window over ranges runs over one row a range.
    """
    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(stored(chunks, "cut").repartitionByRange(parts, "doc_id", "win").withColumn("part", F.spark_partition_id()), "chunks")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "win")))
    return rows.join(offsets, "part").withColumn("chunk_id", (F.col("before") + F.col("k") - 1).cast("long")).drop("part", "k", "before")


def numbered_on(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Further chunks, numbered on from the largest number of the base; the base's own rows aren't among them."""
    start = base.agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0)).alias("_start"))  # one row
    return numbered(extra.drop("chunk_id")).crossJoin(start).withColumn("chunk_id", F.col("chunk_id") + F.col("_start")).drop("_start")


def appended(base: DataFrame, *more: DataFrame) -> DataFrame:
    """Numbered chunks with further chunk tables after them: those are numbered on from the largest number so far, and the base
    keeps its numbers. Empty tables add nothing."""
    out = base
    for extra in more:
        out = out.unionByName(numbered_on(out, extra))
    return out


def corpus_stats(docs: DataFrame) -> DataFrame:
    n = text.word_count(F.col("text"))
    return docs.agg(F.count("*").alias("documents"), F.countDistinct("title").alias("titles"), F.sum(n).alias("words"), F.round(F.avg(n), 1).alias("mean_words"), F.max(n).alias("max_words"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.col("word_count").cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("drug").alias("drugs"), zero(F.round(F.avg(n), 1)).alias("mean_words"), zero(F.min(n)).alias("min_words"), zero(F.max(n)).alias("max_words"), F.count_if(F.col("win") > 0).alias("continued"))


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def field_coverage(chunks: DataFrame) -> DataFrame:
    """Chunks, titles and the share of all titles of each field."""
    total = chunks.agg(F.countDistinct("title").alias("all_titles"))
    per = chunks.groupBy("field").agg(F.count("*").alias("chunks"), F.countDistinct("title").alias("titles"))
    return per.crossJoin(total).select("field", "chunks", "titles", F.round(100.0 * F.col("titles") / F.col("all_titles"), 1).alias("coverage"))


def title_sections(chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The sections and chunks of each title, or of the titles of a table (title) alone."""
    if titles is not None:
        chunks = chunks.join(titles.select("title").distinct(), "title", "left_semi")
    return chunks.groupBy("title").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("sections"), F.count("*").alias("chunks"))


def headline(chunks: DataFrame) -> DataFrame:
    upload = F.col("origin") != CORPUS
    return chunks.agg(F.countDistinct(F.when(~upload, F.col("title"))).alias("drugs"), F.count("*").alias("chunks"), F.countDistinct("field").alias("sections"), F.countDistinct(F.when(upload, F.col("origin"))).alias("uploads"))


def title_search(rows: DataFrame, needle: str, k: int = 40) -> DataFrame:
    """The first k titles that hold a piece of text, in order."""
    return rows.where(F.contains(F.lower("title"), F.lit(needle.strip().lower()))).select("title").distinct().orderBy("title").limit(k)


def fingerprint(docs: DataFrame, model: str, order: str = "doc_id") -> DataFrame:
    """One digest of model name, count and all texts in order: texts are hashed apart, then their digests in one pass of order.

    The digests of a bucket of ids are hashed together, and the buckets' digests again, so no step gathers all texts.
    """
    leaf = docs.select(F.floor(F.col(order) / 4096).alias("bucket"), F.struct(F.col(order).alias("o"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\0")), 256).alias("h")).alias("x"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    per = leaf.groupBy("bucket").agg(joined("x").alias("h"), F.count("*").alias("n"))
    root = per.agg(joined(F.struct(F.col("bucket").alias("o"), "h")).alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return root.select(F.col("n").alias("n"), F.sha2(F.concat_ws("|", F.lit(model), F.col("n").cast("string"), "h"), 256).alias("fingerprint"))


def content_digest(rows: DataFrame, model: str, *columns: str) -> DataFrame:
    """One digest of model name and all rows, whatever their order: the sums of four parts of the rows' SHA-256 are hashed together,
    so that each task hands on four numbers."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return rows.select(row.alias("h")).agg(F.sha2(F.concat_ws("|", F.lit(model), F.count("*").cast("string"), *parts), 256).alias("fingerprint"))


def within_budget(sections: DataFrame, group: Column | str, order: str, budget: int) -> DataFrame:
    """Sections in order up to a budget of characters, the last one cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sections.withColumn("before", before).where(F.col("before") < budget)
    return rows.withColumn("text", F.expr(f"substring(text, 1, cast({budget} - before as int))")).drop("before")
