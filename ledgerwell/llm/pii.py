"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal what the patterns find.

Each different e-mail address, IP address, card or phone number is a protected entity. The terms within NEAR words of its
mentions are counted over the corpus: P(c|t) is the share of the documents with term t in which t stands near entity c, with
PRIOR documents drawn at the corpus's own rate P(c) added. The information IC(c) = -log2 P(c) is what t may give away; t
discloses c when its pointwise mutual information log2(P(c|t) / P(c)) reaches the share DISCLOSED of IC(c). Terms that stand
near c in one context only, however often that was copied, are no evidence; entities in more than one of PUBLIC documents are
no secret. A disclosing term is generalised to its first letters where the class of words with these letters stays below
the threshold for all entities concerned, else removed, wherever in the corpus it occurs.

All of it is built from column functions: patterns that don't go back over what they read, counts by grouped sums, and joins on
terms and on digests of texts, whose hot keys are dealt over tasks.

Null text is empty and gives the digest of the empty string; spans count code points, end exclusive; a text is scanned whole,
however long; repeated rows count as documents but are one context; equal texts get equal spans; a term that meets a base
span is left to it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.common import let, spread_join, table, written
from ledgerwell.llm.spans import clear_of, located, replaced

#: Kinds in order and their patterns. A match starts where a run does, or where the last match ended, and gives nothing back.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"
IP = rf"\A(?:{_PART}(?:\.|\z)){{4}}\z"
#: A term: a letter with two or more letters and digits after it.
TERM = r"\p{L}[\p{L}\p{M}\p{N}]{2,}+"
#: Words on each side of a mention that count as near, and the code points they are taken from.
NEAR, AROUND = 8, 200
DISCLOSED, PRIOR, PUBLIC, CONTEXTS = 0.9, 1.0, 100, 2
#: Letters that are left of a generalised term.
STEM = 3
GENERAL, REMOVED = "general", "removed"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    size = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(IP)
    if kind == "card":
        return F.when(size.between(16, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    return size.between(8, 15) if kind == "phone" else F.lit(True)


def _found(text: Column, k: int) -> Column:
    """The valid matches of a kind; texts without its marks aren't searched."""
    marked = text.contains("@") if k == 0 else text.contains("+") if k == 3 else text.rlike(r"[0-9]\.[0-9]" if k == 1 else "[0-9][ -]?[0-9]")
    spans = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(marked, located(text, PATTERNS[k], lambda m: _valid(KINDS[k], m))).otherwise(spans)


def _windows(text: Column, k: int) -> Column:
    """For each valid mention of a kind: the entity, the terms near it, and a digest of these. Terms are read from the ends of what
    lies between matches, so that no text is cut at places far inside it."""

    def terms(part: Column, last: bool) -> Column:
        found = F.regexp_extract_all(F.lower(part), F.lit(TERM), F.lit(0))
        size = F.least(F.size(found), F.lit(NEAR))
        return F.slice(found, F.size(found) - size + 1, size) if last else F.slice(found, F.lit(1), size)

    def window(m: Column, i: Column, gaps: Column) -> Column:
        near = F.concat(terms(F.right(F.get(gaps, i), F.lit(AROUND)), True), terms(F.left(F.get(gaps, i + 1), F.lit(AROUND)), False))
        value = F.lower(m) if k in (0, 1) else _digits(m)
        return let(near, lambda t: F.struct(F.concat(F.lit(KINDS[k] + ":"), value).alias("entity"), F.xxhash64(t).alias("context"), F.array_distinct(t).alias("terms")))

    found = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias("m"), F.split(text, PATTERNS[k], -1).alias("gaps"))
    numbered = lambda s: F.filter(F.transform(s["m"], lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: _valid(KINDS[k], x["m"]))
    return let(found, lambda s: F.transform(numbered(s), lambda x: window(x["m"], x["i"], s["gaps"])))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _stem(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(STEM)), F.lit("*"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest of the text, base (spans of the four kinds, with kind) and windows; written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda k: F.transform(_found(text, k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = docs.select("doc_id", "text", *(bare(k).alias(f"_s{k}") for k in range(len(KINDS))))
    none = F.array().cast("array<struct<entity:string,context:bigint,terms:array<string>>>")
    windows = F.concat(*(F.when(F.size(f"_s{k}") > 0, _windows(text, k)).otherwise(none) for k in range(len(KINDS))))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), _digest(text).alias("digest"), F.concat(*(f"_s{k}" for k in range(len(KINDS)))).alias("base"), windows.alias("windows"))
    return written(rows, "pii")


def disclosures(docs: DataFrame, seen: DataFrame) -> DataFrame | None:
    """term and action (general or removed) of the terms that disclose an entity, written; None where no term can."""
    n_docs = seen.count()
    mentions = written(seen.select("row", F.explode("windows").alias("w")).select("row", "w.entity", "w.context", F.explode("w.terms").alias("term")), "mentions")
    counts = lambda key: mentions.groupBy("entity", key.alias("key")).agg(F.count_distinct("row").alias("together"), F.count_distinct("context").alias("contexts"))
    near = written(counts(F.col("term")).where(F.col("contexts") >= CONTEXTS), "near")
    if near.isEmpty():
        return None
    entities = seen.select("row", F.explode("windows.entity").alias("entity")).groupBy("entity").agg(F.count_distinct("row").alias("n_entity")).where(F.col("n_entity") * PUBLIC <= n_docs)
    classes = counts(_stem(F.col("term"))).select("entity", F.col("key").alias("stem"), F.col("together").alias("stem_together"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    keys = let(words, lambda w: F.concat(w, F.array_distinct(F.transform(w, _stem))))
    wanted = near.select("key").union(near.select(_stem(F.col("key")).alias("key"))).distinct()
    n_with = docs.select(F.explode(keys).alias("key")).join(wanted, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    n_with = written(n_with, "terms")
    info = -F.log2(F.col("n_entity") / n_docs)

    def disclosed(together: str, n: str) -> Column:
        share = (F.col(together) + PRIOR * F.col("n_entity") / n_docs) / (F.col(n) + PRIOR)
        return F.log2(share * n_docs / F.col("n_entity")) >= DISCLOSED * info

    joined = near.join(entities, "entity").withColumn("stem", _stem(F.col("key"))).join(classes, ["entity", "stem"])
    joined = joined.join(n_with, "key").join(n_with.select(F.col("key").alias("stem"), F.col("n").alias("n_stem")), "stem")
    risky = joined.where(disclosed("together", "n")).groupBy(F.col("key").alias("term")).agg(F.max(disclosed("stem_together", "n_stem")).alias("both"))
    return written(risky.select("term", F.when(F.col("both"), REMOVED).otherwise(GENERAL).alias("action")), "disclosures")


def sanitised_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest, base and added (spans of disclosing terms: start, end, action, mask) for each row of docs."""
    seen = scanned(docs)
    none = F.array().cast("array<struct<start:int,end:int,action:string,mask:string>>")
    risky = disclosures(docs, seen)
    if risky is None:
        return seen.select("doc_id", "row", "digest", "base", none.alias("added"))
    text = F.coalesce(F.col("text"), F.lit(""))
    terms = docs.select(_digest(text).alias("digest"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    per_text = written(terms.join(risky, "term").groupBy("digest").agg(F.collect_set(F.struct("term", "action")).alias("risky")), "risky")
    texts = docs.select(text.alias("text"), F.monotonically_increasing_id().alias("_by")).withColumn("digest", _digest(F.col("text")))
    held = spread_join(texts, per_text, "digest", "_by")
    base = F.array(*(_found(F.col("text"), k) for k in range(len(KINDS))))

    def added(s: Column) -> Column:
        names = F.transform(s["risky"], lambda r: r["term"])
        hits = located(F.col("text"), TERM, lambda m: F.array_contains(names, F.lower(m)))
        clear = F.filter(hits, lambda x: F.forall(s["base"], lambda b: clear_of(x, b)))
        action = lambda m: F.get(s["risky"], F.array_position(names, F.lower(m)).cast("int") - 1)["action"]
        with_action = F.transform(clear, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), action(x["match"]).alias("action"), x["match"].alias("match")))
        mask = lambda x: F.when(x["action"] == GENERAL, _stem(x["match"])).otherwise("")
        return F.transform(with_action, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["action"].alias("action"), mask(x).alias("mask")))

    found = held.select("digest", let(F.struct("risky", base.alias("base")), added).alias("added"))
    once = written(found.groupBy("digest").agg(F.first("added").alias("added")), "added")
    return spread_join(seen, once, "digest", "row", "left").select("doc_id", "row", "digest", "base", F.coalesce("added", none).alias("added"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data masked by kind, disclosing terms cut to their first letters or removed, and n_chars, where there is one, counted again.

    Overlapping spans are masked as one; null texts stay null; all columns pass through, whatever their names.
    """
    spans = sanitised_spans(docs)
    own = docs.select(F.struct("*").alias("own"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_by")).withColumn("digest", _digest(F.col("text")))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    once = spans.where((F.size("base") > 0) | (F.size("added") > 0)).groupBy("digest").agg(F.first("base").alias("base"), F.first("added").alias("added"))
    held = spread_join(own, once, "digest", "_by", "left")
    based = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("mask")))
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mask"].alias("mask")))
    made = held.select("own", F.when(F.col("base").isNotNull(), replaced(F.col("text"), F.array_sort(F.concat(based, more)))).otherwise(F.col("own.text")).alias("made"))
    new = {"text": F.col("made"), "n_chars": F.length("made").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return made.select(*(F.when(F.col("own.text").isNull(), F.col("own").getField(c)).otherwise(new[c]).alias(c) if c in new else F.col("own").getField(c).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sanitised_spans(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    named = F.transform("base", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    more = F.array_sort(F.transform("added", lambda s: F.struct(s["action"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return spans.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))), F.sha2(_joined(named), 256).alias("base_sha256"), _joined(F.concat(named, more)).alias("spans"))


_CUT = "SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY {by} ORDER BY i)::BIGINT AS z FROM (SELECT {by}, unnest(ms) AS m, unnest(range(len(ms))) AS i, unnest(gs[1:len(ms)]) AS g, unnest(gs[2:]) AS g2 FROM {of})"
_TERM_SQL = TERM.replace("}+", "}")
_HIGH = f"log2(({{together}} + {PRIOR} * n_entity / n_docs) / ({{n}} + {PRIOR}) * n_docs / n_entity) >= {DISCLOSED} * -log2(n_entity / n_docs)"
OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, (SELECT count(*) FROM documents)::DOUBLE AS n_docs FROM documents),
kinds(k, pattern) AS (VALUES (0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, '[0-9]([ -]?[0-9])+'), (3, '\+[0-9][ ().0-9-]+[0-9]')),
matched AS ({" UNION ALL ".join(f"SELECT row, {k} AS k, regexp_extract_all(text, (SELECT pattern FROM kinds WHERE k = {k})) AS ms, string_split_regex(text, (SELECT pattern FROM kinds WHERE k = {k})) AS gs FROM docs" for k in range(4))}),
cut AS ({_CUT.format(by="row, k", of="matched")}),
judged AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM cut),
base AS (
  SELECT row, k, z - length(m) AS a, z, g, g2, CASE k WHEN 0 THEN 'email:' || lower(m) WHEN 1 THEN 'ip:' || lower(m) WHEN 2 THEN 'card:' || d ELSE 'phone:' || d END AS entity FROM judged
  WHERE CASE k WHEN 0 THEN true WHEN 3 THEN length(d) BETWEEN 8 AND 15
    WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    ELSE length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(d)), lambda j: substr(d, length(d) - j, 1)::INT * (1 + j % 2) - CASE WHEN substr(d, length(d) - j, 1)::INT * (1 + j % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0 END),
windows AS (SELECT row, entity, list_concat(regexp_extract_all(lower(right(g, {AROUND})), '{_TERM_SQL}')[-{NEAR}:], regexp_extract_all(lower(left(g2, {AROUND})), '{_TERM_SQL}')[1:{NEAR}]) AS context FROM base),
mentions AS (SELECT row, entity, context, unnest(list_distinct(context)) AS term FROM windows),
near AS (SELECT entity, term, left(term, {STEM}) || '*' AS stem, count(DISTINCT row) AS together FROM mentions GROUP BY entity, term HAVING count(DISTINCT context) >= {CONTEXTS}),
classes AS (SELECT entity, left(term, {STEM}) || '*' AS stem, count(DISTINCT row) AS stem_together FROM mentions GROUP BY ALL),
entities AS (SELECT entity, count(DISTINCT row) AS n_entity FROM windows GROUP BY entity HAVING count(DISTINCT row) * {PUBLIC} <= (SELECT count(*) FROM documents)),
words AS (SELECT row, unnest(list_distinct(regexp_extract_all(lower(text), '{_TERM_SQL}'))) AS word FROM docs),
counts AS (SELECT word AS key, count(*) AS n FROM words GROUP BY 1 UNION ALL SELECT left(word, {STEM}) || '*', count(DISTINCT row) FROM words GROUP BY 1),
risky AS (
  SELECT term, CASE WHEN bool_or({_HIGH.format(together="stem_together", n="s.n")}) THEN '{REMOVED}' ELSE '{GENERAL}' END AS action
  FROM near JOIN entities USING (entity) JOIN classes USING (entity, stem) JOIN counts t ON t.key = term JOIN counts s ON s.key = stem, (SELECT count(*)::DOUBLE AS n_docs FROM documents)
  WHERE {_HIGH.format(together="together", n="t.n")} GROUP BY term),
held AS (SELECT row, regexp_extract_all(text, '{_TERM_SQL}') AS ms, string_split_regex(text, '{_TERM_SQL}') AS gs FROM docs WHERE row IN (SELECT row FROM words JOIN risky ON term = word)),
said AS ({_CUT.format(by="row", of="held")}),
added AS (SELECT row, action, z - length(m) AS a, z FROM said s JOIN risky ON term = lower(m) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = s.row AND b.a < s.z AND s.z - length(s.m) < b.z)),
names AS (SELECT row, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
  string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || a || ':' || z, ',' ORDER BY k, a) AS own FROM base GROUP BY row),
more AS (SELECT row, string_agg(action || ':' || a || ':' || z, ',' ORDER BY action, a) AS extra FROM added GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(own, '')) AS base_sha256, concat_ws(',', own, extra) AS spans
FROM docs LEFT JOIN names USING (row) LEFT JOIN more USING (row)
"""
