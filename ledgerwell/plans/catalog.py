"""Registered queries of the engine on the supplied tables, each beside its DuckDB SQL.

`documents` is the corpus (source as title, lang as field), `benchmark` the questions, `embeddings` the dense store, `part`
the entity names, `lineitem` the pair table. Where the tables hold no case of an operator, inline rows stand in on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions import lists, stems, text
from ledgerwell.operators import answers, chunking, dense, evaluation, grounding, hybrid, lexical, packs, pairs, phrases, routing, shards
from ledgerwell.operators import trace as steps
from ledgerwell.session import dealt, new_path, stored
from ledgerwell.sources import labels, records, uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("field"), F.lit("doc").alias("category"), "text", F.lit(chunking.CORPUS).alias("origin"))


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _values(rows) -> str:
    """Rows as SQL values."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


FLAT = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
WORDS_CTE = f"w AS (SELECT doc_id, lang, source, text, {FLAT.format('text')} AS flat FROM documents), t AS (SELECT *, CASE WHEN flat = '' THEN []::VARCHAR[] ELSE string_split(flat, ' ') END AS ws FROM w)"


# --- corpus statistics -----------------------------------------------------------------------------------------------


@query(f"WITH {WORDS_CTE} SELECT count(*) AS documents, count(DISTINCT source) AS titles, sum(len(ws))::BIGINT AS words, round(avg(len(ws)), 1) AS mean_words, max(len(ws)) AS max_words FROM t")
def corpus_stats(spark, sf_dir):
    return chunking.corpus_stats(_docs(spark, sf_dir))


@query("SELECT lang AS field, count(*) AS chunks, count(DISTINCT source) AS titles, round(100.0 * count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents), 1)::DOUBLE AS coverage FROM documents GROUP BY 1")
def field_coverage(spark, sf_dir):
    return chunking.field_coverage(_docs(spark, sf_dir))


@query("SELECT source AS title, array_to_string(list_sort(list_distinct(list(lang))), ', ') AS sections, count(*) AS chunks FROM documents GROUP BY 1")
def title_sections(spark, sf_dir):
    return chunking.title_sections(_docs(spark, sf_dir))


@query("SELECT lang AS field, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, field LIMIT 10")
def field_counts(spark, sf_dir):
    return chunking.top_values(_docs(spark, sf_dir), "field")


@query("SELECT count(DISTINCT CASE WHEN lang <> 'es' THEN source END) AS drugs, count(*) AS chunks, count(DISTINCT lang) AS sections, count(DISTINCT CASE WHEN lang = 'es' THEN 'upload:es' END) AS uploads FROM documents")
def headline_metrics(spark, sf_dir):
    origin = F.when(F.col("field") == "es", "upload:es").otherwise(chunking.CORPUS)
    return chunking.headline(_docs(spark, sf_dir).withColumn("origin", origin))


@query("SELECT DISTINCT source AS title FROM documents WHERE contains(lower(source), 'src1') ORDER BY 1 LIMIT 40")
def title_search(spark, sf_dir):
    return chunking.title_search(_docs(spark, sf_dir), " SRC1 ")


@query("""
WITH leaf AS (SELECT doc_id // 4096 AS bucket, doc_id, sha256(coalesce(text, '') || chr(0)) AS h FROM documents),
per AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY doc_id)) AS h, count(*) AS n FROM leaf GROUP BY 1),
root AS (SELECT sha256(string_agg(h, '' ORDER BY bucket)) AS h, sum(n)::BIGINT AS n FROM per)
SELECT n, sha256('model|' || n || '|' || h) AS fingerprint FROM root""")
def corpus_fingerprint(spark, sf_dir):
    return chunking.fingerprint(_docs(spark, sf_dir), "model")


# --- documents and chunks --------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT trim(p_name) AS title, 'uncategorized' AS category, unnest([{'f': 'description', 'k': 0, 'b': p_name}, {'f': 'mechanism', 'k': 1, 'b': p_brand}, {'f': 'indications', 'k': 2, 'b': p_type}]) AS x FROM part)
SELECT lower(title) || '::' || x.f AS doc_id, title, x.f AS field, category, x.b AS text, count(*) AS n FROM p WHERE x.b <> '' AND title <> '' GROUP BY ALL""")
def unpivot_records(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("").alias("category"), F.col("p_name").alias("description"), F.col("p_brand").alias("mechanism"), F.col("p_type").alias("indications"))
    out = chunking.documents_from_records(p, ("description", "mechanism", "indications"))
    return out.groupBy("doc_id", "title", "field", "category", "text").agg(F.count("*").alias("n"))


_WINDOWS = f"{WORDS_CTE}, c AS (SELECT doc_id, lang, source, text, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 90 THEN 1 ELSE ceil((len(ws) - 90) / 65.0)::BIGINT + 1 END)) AS win FROM t), cut AS (SELECT *, CASE WHEN len(ws) <= 90 THEN text ELSE array_to_string(ws[win * 65 + 1:win * 65 + 90], ' ') END AS piece FROM c)"


@query(f"WITH {_WINDOWS} SELECT doc_id, win, length(piece) AS n_chars, md5(piece) AS digest FROM cut")
def word_windows(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.windows(F.col("text"))).alias("win", "piece"))
    return rows.select("doc_id", F.col("win").cast("long").alias("win"), F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("digest"))


_CHUNKS = _WINDOWS + f", ch AS (SELECT doc_id, lower(source) AS drug, source AS title, lang AS field, win, source || ' — ' || lang || ': ' || piece AS text FROM cut), chunks AS (SELECT *, len(string_split({FLAT.format('text')}, ' ')) AS word_count FROM ch)"


@query(f"WITH {_CHUNKS} SELECT doc_id, drug, title, 'doc' AS category, field, win::INT AS win, md5(text) AS digest, word_count::INT AS word_count, row_number() OVER (ORDER BY doc_id, win) - 1 AS chunk_id FROM chunks")
def chunk_table(spark, sf_dir):
    rows = chunking.numbered(chunking.chunk_table(_docs(spark, sf_dir), profile="minimal"))
    return rows.select("doc_id", "drug", "title", "category", "field", "win", F.md5("text").alias("digest"), "word_count", F.col("chunk_id").cast("long").alias("chunk_id"))


@query(f"WITH {_CHUNKS} SELECT doc_id, win::INT AS win, row_number() OVER (ORDER BY CASE WHEN field = 'es' THEN 1 WHEN field = 'fr' THEN 2 ELSE 0 END, doc_id, win) - 1 AS chunk_id FROM chunks")
def appended_chunks(spark, sf_dir):
    """Chunks of one part of the documents, then of two others, numbered on."""
    chunks = chunking.chunk_table(_docs(spark, sf_dir), profile="minimal")
    base = chunking.numbered(chunks.where("field not in ('es', 'fr')"))
    out = chunking.appended(base, chunks.where("field = 'none'"), chunks.where("field = 'es'"), chunks.where("field = 'fr'"))
    return out.select("doc_id", "win", F.col("chunk_id").cast("long").alias("chunk_id"))


@query("SELECT source AS title, array_to_string(list_sort(list_distinct(list(lang))), ', ') AS sections, count(*) AS chunks FROM documents WHERE source IN ('src1', 'src2', 'nowhere') GROUP BY 1")
def chosen_title_sections(spark, sf_dir):
    return chunking.title_sections(_docs(spark, sf_dir), spark.createDataFrame([("src1",), ("src2",), ("nowhere",), ("src1",)], "title string"))


@query(r"""
WITH c AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN source || ' — ' || lang || ': ' || text ELSE text END AS text FROM documents),
b AS (SELECT *, CASE WHEN starts_with(text, source || ' — ' || lang || ': ') THEN substr(text, length(source || ' — ' || lang || ': ') + 1) ELSE text END AS body FROM c)
SELECT doc_id, source || ' · ' || lang AS label, 'https://x/?q=' || replace(url_encode(substr(text, 1, 40)), '%2F', '/') || '&limit=1' AS link,
  md5(CASE WHEN length(body) > 320 THEN regexp_replace(substr(body, 1, 320), '\s+$', '') || '…' ELSE body END) AS digest FROM b""")
def source_cards(spark, sf_dir):
    heading = F.concat("title", F.lit(" — "), "field", F.lit(": "))
    rows = _docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(heading, "text")).otherwise(F.col("text")))
    snippet = text.card_snippet(F.col("text"), F.col("title"), F.col("field"))
    return rows.select("doc_id", text.citation_label(F.col("title"), F.col("field")).alias("label"), text.link("https://x/?q={}&limit=1", F.substring("text", 1, 40)).alias("link"), F.md5(snippet).alias("digest"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT drug) AS drugs, coalesce(round(avg(word_count), 1), 0) AS mean_words, coalesce(min(word_count), 0) AS min_words, coalesce(max(word_count), 0) AS max_words, count(*) FILTER (win > 0) AS continued FROM chunks")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunking.chunk_table(_docs(spark, sf_dir), profile="minimal"))


@query(r"""
WITH s AS (SELECT page_id, html, string_split_regex(html, '</p>|</h1>') AS parts FROM pages)
SELECT page_id, len(parts) AS n_parts, len(list_filter(parts, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) <> '')) AS n_sections FROM s""")
def html_sections(spark, sf_dir):
    parts = F.split("html", "</p>|</h1>", -1)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    return _read(spark, sf_dir, "pages").select("page_id", F.size(parts).cast("long").alias("n_parts"), F.size(F.filter(parts, lambda x: bare(x) != "")).cast("long").alias("n_sections"))


@query("""
WITH o AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source AS title, doc_id, length(substring(text, 1, (20000 - before)::BIGINT)) AS n_chars, md5(substring(text, 1, (20000 - before)::BIGINT)) AS digest FROM o WHERE before < 20000""")
def upload_budget(spark, sf_dir):
    cut = chunking.within_budget(_docs(spark, sf_dir), "title", "doc_id", 20000)
    return cut.select("title", "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


# --- cleaning and tokens ---------------------------------------------------------------------------------------------

_LOWER = r"lower(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'))"
_KEEP = [w for w in lists.STOP_WORDS if w not in lists.NEGATIONS]


@query(f"SELECT doc_id, md5({FLAT.format(_LOWER)}) AS digest FROM documents")
def clean_minimal(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.cleaned(F.col("text"), "minimal")).alias("digest"))


_WORD = text.WORD.replace("'", "''")
_CLEAN_CTE = f"m AS (SELECT doc_id, lang, source, text, {FLAT.format(_LOWER)} AS flat FROM documents), k AS (SELECT *, list_filter(regexp_extract_all(flat, '{_WORD}'), lambda x: NOT list_contains({_sql_list(_KEEP)}, x)) AS ws FROM m)"


@query(f"WITH {_CLEAN_CTE} SELECT doc_id, len(ws) AS n_tokens, md5(array_to_string(ws, ' ')) AS digest FROM k")
def clean_stopwords(spark, sf_dir):
    c = text.cleaned(F.col("text"), "stopwords")
    return _docs(spark, sf_dir).select("doc_id", F.size(text.tokens(c)).cast("long").alias("n_tokens"), F.md5(c).alias("digest"))


_MARKS = text.PUNCTUATION.replace("'", "''")
_PLAIN = FLAT.replace("{0}", "regexp_replace(translate(" + _LOWER + ", '" + _MARKS + "', ''), '\\b\\d+\\b', '', 'g')")


@query(f"SELECT doc_id, md5({_PLAIN}) AS digest FROM documents")
def clean_plain(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.clean(F.col("text"), punctuation=True, numbers=True)).alias("digest"))


def _map_sql(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in table.items())}}}"


_SINGULAR = f"""CASE WHEN list_contains({_sql_list(lists.NEGATIONS)}, x) THEN x WHEN list_contains({_sql_list(lists.IRREGULAR_PLURALS)}, x) THEN {_map_sql(lists.IRREGULAR_PLURALS)}[x]
  WHEN regexp_matches(x, '^[a-z]{{2,}}ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '(ss|us|is)$') THEN x
  WHEN regexp_matches(x, '(ch|sh|ss|x|z)es$') THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '^[a-z]{{3,}}s$') THEN regexp_replace(x, 's$', '') ELSE x END"""
_READABLE = f"list_transform(list_filter(regexp_extract_all({FLAT.format(_LOWER)}, '{_WORD}'), lambda x: NOT list_contains({_sql_list(_KEEP)}, x)), lambda x: {_SINGULAR})"


def _stem_sql(source: str) -> str:
    """CTEs from source (w) to stems (w, stem), a step at a time; x is the word so far."""

    def shape(x: str) -> str:
        for pattern, new in (("[^aeiouy]", "c"), ("[aeiou]", "v"), ("(^|v)y", "\\1c"), ("yy", "vc"), ("y", "v")):
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
        return x

    cut = lambda x, n: f"left({x}, length({x}) - {n})"
    least = lambda x, n: f"regexp_matches({shape(x)}, '{'.*'.join(['vc'] * n)}')"
    closed = lambda x: f"CASE WHEN length({x}) = 2 THEN {shape(x)} = 'vc' ELSE right({shape(x)}, 3) = 'cvc' AND NOT regexp_matches({x}, '[wxy]$') END"
    ends = lambda p: f"regexp_matches(x, '{p}$')"

    def step(rules: dict[str, str], fits: str) -> str:
        return f"CASE WHEN e <> '' AND {fits} THEN {cut('x', 'length(e)')} || {_map_sql(rules)}[e] ELSE x END", f"regexp_extract(x, '({'|'.join(rules)})$', 1)"

    stem = cut("x", "length(e)")
    last = f"CASE WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN length(x) >= 2 AND right(x, 1) = substr(x, length(x) - 1, 1) AND right({shape('x')}, 1) = 'c' THEN CASE WHEN regexp_matches(x, '[lsz]$') THEN x ELSE {cut('x', 1)} END WHEN {least('x', 1)} AND NOT {least('x', 2)} AND {closed('x')} THEN x || 'e' ELSE x END"
    steps = [
        (f"CASE WHEN {ends('^.ies')} THEN {cut('x', 1)} WHEN {ends('(sses|ies)')} THEN {cut('x', 2)} WHEN {ends('([^s]|^)s')} THEN {cut('x', 1)} ELSE x END", "''"),
        (f"CASE WHEN {ends('^.ied')} THEN {cut('x', 1)} WHEN {ends('ied')} THEN {cut('x', 2)} WHEN {ends('eed')} THEN CASE WHEN {least(cut('x', 3), 1)} THEN {cut('x', 1)} ELSE x END WHEN e <> '' AND contains({shape(stem)}, 'v') THEN '+' || {stem} ELSE x END", "regexp_extract(x, '(ed|ing)$', 1)"),
        (f"CASE WHEN e = '+' THEN (SELECT {last} FROM (SELECT substr(o.x, 2) AS x)) ELSE x END", "left(x, 1)"),
        (f"CASE WHEN {ends('^..+y')} AND right({shape(cut('x', 1))}, 1) = 'c' THEN {cut('x', 1)} || 'i' ELSE x END", "''"),
        (f"CASE WHEN {ends('alli')} AND {least(cut('x', 4), 1)} THEN {cut('x', 2)} ELSE x END", "''"),
        step(lists.STEM_DOUBLE, least(f"({stem} || CASE WHEN e = 'logi' THEN 'l' ELSE '' END)", 1)),
        step(lists.STEM_SINGLE, least(stem, 1)),
        step(lists.STEM_LAST, f"{least(stem, 2)} AND (e <> 'ion' OR regexp_matches({stem}, '[st]$'))"),
        (f"CASE WHEN {ends('e')} AND ({least(cut('x', 1), 2)} OR {least(cut('x', 1), 1)} AND NOT {closed(cut('x', 1))}) THEN {cut('x', 1)} ELSE x END", "''"),
        (f"CASE WHEN {ends('ll')} AND {least(cut('x', 1), 2)} THEN {cut('x', 1)} ELSE x END", "''"),
    ]
    out, before = "", f"(SELECT w, w AS x FROM {source})"
    for k, (change, ending) in enumerate(steps):
        out += f"st{k} AS (SELECT w, {change} AS x FROM (SELECT *, {ending} AS e FROM {before}) o), "
        before = f"st{k}"
    own = f"CASE WHEN length(w) <= 2 OR list_contains({_sql_list(lists.NEGATIONS)}, w) THEN w WHEN list_contains({_sql_list(lists.STEM_IRREGULAR)}, w) THEN {_map_sql(lists.STEM_IRREGULAR)}[w] ELSE x END"
    return out + f"stems AS (SELECT w, {own} AS stem FROM {before})"


def _all_words(flat: str) -> str:
    return f"aw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT doc_id, regexp_extract_all({flat}, '{_WORD}') AS ws FROM documents)), dw AS (SELECT DISTINCT w FROM aw)"


def _words(spark, sf_dir) -> DataFrame:
    """The different words of the lower-cased documents."""
    flat = text.cleaned(F.col("text"), "minimal")
    return _docs(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all(flat, F.lit(text.WORD), F.lit(1)))).alias("word")).distinct()


@query(f"WITH {_all_words(FLAT.format(_LOWER))}, {_stem_sql('dw')} SELECT w AS word, stem FROM stems")
def word_stems(spark, sf_dir):
    return _words(spark, sf_dir).select("word", stems.stem(F.col("word")).alias("stem"))


@query(f"WITH {_all_words(FLAT.format(_LOWER))} SELECT x AS word, {_SINGULAR} AS lemma FROM (SELECT w AS x FROM dw)")
def word_lemmas(spark, sf_dir):
    return _words(spark, sf_dir).select("word", stems.lemma(F.col("word")).alias("lemma"))


@query(f"""
WITH {_all_words(FLAT.format(_LOWER))}, dict AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all({FLAT.format(_LOWER)}, '{_WORD}')) AS w FROM benchmark)),
forms AS (SELECT w, unnest([w, {', '.join(f"CASE WHEN suffix(w, '{a}') THEN left(w, length(w) - {len(a)}) || '{b}' END" for a, b in lists.NOUN_ENDINGS)}]) AS form FROM dw)
SELECT dw.w AS word, coalesce(arg_min(d.w, {{'n': length(d.w), 'f': d.w}}), dw.w) AS lemma FROM dw LEFT JOIN forms f ON f.w = dw.w LEFT JOIN dict d ON d.w = f.form GROUP BY dw.w""")
def dictionary_lemmas(spark, sf_dir):
    """The benchmark's words as the dictionary of the documents' words."""
    flat = text.cleaned(F.col("text"), "minimal")
    held = _read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(flat, F.lit(text.WORD), F.lit(1))).alias("word"))
    return stems.lemma_table(_words(spark, sf_dir), held)


@query(f"SELECT doc_id, md5(array_to_string({_READABLE}, ' ')) AS digest FROM documents")
def clean_readable(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.cleaned(F.col("text"), "readable")).alias("digest"))


@query(f"""
WITH {_all_words(_PLAIN)}, {_stem_sql('dw')}
SELECT d.doc_id, md5(coalesce(string_agg(stem, ' ' ORDER BY k), '')) AS digest FROM documents d
LEFT JOIN (SELECT * FROM aw JOIN stems USING (w) WHERE NOT list_contains({_sql_list(lists.STOP_WORDS)}, w)) s ON s.doc_id = d.doc_id GROUP BY d.doc_id""")
def clean_aggressive(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.cleaned(F.col("text"), "aggressive")).alias("digest"))


@query(f"""
WITH {_CLEAN_CTE}, a AS (SELECT *, CASE WHEN flat = '' THEN []::VARCHAR[] ELSE string_split(flat, ' ') END AS all_ws FROM k)
SELECT doc_id, len(list_filter(all_ws, lambda x: list_contains({_sql_list(lists.NEGATIONS)}, x))) AS negations, len(list_filter(ws, lambda x: list_contains({_sql_list(lists.NEGATIONS)}, x))) AS negations_kept,
  len(list_filter(all_ws, lambda x: regexp_matches(x, '[0-9]'))) AS numbers, len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) AS numbers_kept FROM a""")
def negation_number_safety(spark, sf_dir):
    before, after = text.tokens(text.cleaned(F.col("text"), "minimal")), text.tokens(text.cleaned(F.col("text"), "stopwords"))
    safe = F.array(*map(F.lit, lists.NEGATIONS))
    count = lambda ws, f: F.size(F.filter(ws, f)).cast("long")
    negation, number = (lambda w: F.array_contains(safe, w)), (lambda w: w.rlike("[0-9]"))
    return _docs(spark, sf_dir).select("doc_id", count(before, negation).alias("negations"), count(after, negation).alias("negations_kept"), count(before, number).alias("numbers"), count(after, number).alias("numbers_kept"))


_ID = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z\\-]{{2,}}'), lambda x: NOT list_contains(" + _sql_list(lists.SALT_WORDS) + ", x))))"


@query(f"SELECT DISTINCT p_name, array_to_string({_ID.format('p_name')}, ' ') AS tokens FROM part")
def identity_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_name", F.array_join(F.array_sort(text.identity_tokens(F.col("p_name"))), " ").alias("tokens")).distinct()


@query(f"SELECT DISTINCT unnest({_ID.format('p_name')}) AS token FROM part")
def entity_vocab(spark, sf_dir):
    return grounding.vocabulary(_read(spark, sf_dir, "part"), "p_name")


@query(f"WITH s AS (SELECT trim(p_type) AS name, {_ID.format('p_type')} AS t FROM part UNION ALL SELECT trim(p_name), {_ID.format('p_name')} FROM part) SELECT t[1] AS token, min_by(name, (length(name), name)) AS name FROM s WHERE len(t) = 1 GROUP BY 1")
def standalone_names(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return grounding.standalone_names(p.select(F.col("p_type").alias("name")).unionByName(p.select(F.col("p_name").alias("name"))))


# --- lexical ---------------------------------------------------------------------------------------------------------

_INDEX = f"{_CLEAN_CTE}, post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM k) GROUP BY ALL), dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY 1), dl AS (SELECT doc_id, len(ws) AS dl FROM k), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"
_QUERY_CTE = f"q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all({FLAT.format(_LOWER)}, '{_WORD}'), lambda x: NOT list_contains({_sql_list(_KEEP)}, x))) AS term FROM benchmark) GROUP BY ALL)"
_BM25 = f"{_INDEX}, {_QUERY_CTE}, bm AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN dfreq USING (term) JOIN post USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL)"


def _cleaned(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("chunk_id", F.col("doc_id")).withColumn("clean", text.cleaned(F.col("text"), "stopwords"))


def _questions(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", text.cleaned(F.col("text"), "stopwords").alias("clean"))


_kept_tables: dict = {}


def _kept(spark, sf_dir, name: str, make, tables: tuple[str, ...] = ("documents",)):
    """What several queries read of the documents, made once a session and table; a table that was written anew counts as another."""
    seen = [_read(spark, sf_dir, t).select(F.max("_metadata.file_modification_time"), F.count("*")).first() for t in tables]
    key = spark.sparkContext.applicationId, sf_dir, tuple(map(str, seen)), name
    if key not in _kept_tables:
        _kept_tables[key] = make()
    return _kept_tables[key]


def _index(spark, sf_dir) -> lexical.Index:
    """The stored word index of the documents."""

    def make() -> lexical.Index:
        built = lexical.build_index(stored(_cleaned(spark, sf_dir).select("chunk_id", "clean"), "cleaned"))
        postings, lengths = stored(built.postings, "postings"), stored(built.lengths, "lengths")
        counts = stored(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
        return lexical.Index(postings, lengths, counts, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    return _kept(spark, sf_dir, "index", make)


def _own_ids(spark, sf_dir) -> bool:
    """Whether every document has an id of its own. Where some share one or have none, their words meet by id in joins."""

    def make() -> bool:
        rows, ids = _read(spark, sf_dir, "documents").agg(F.count("*"), F.countDistinct("doc_id")).first()
        return rows == ids

    return _kept(spark, sf_dir, "own-ids", make)


def _packs(spark, sf_dir, grams: bool = False) -> list[packs.Packs]:
    """The documents packed for the questions, with the title and the field as tags."""

    def make() -> list[packs.Packs]:
        docs, asked = _cleaned(spark, sf_dir), _questions(spark, sf_dir)
        rows = docs.select("chunk_id", F.lit(0).alias("win"), F.array("title", "field").alias("tags"), *packs.hashed(F.col("text"), F.col("clean")))
        return packs.packs(rows, asked.select("query_id", *packs.hashed(F.col("text"), F.col("clean"))), grams)

    return _kept(spark, sf_dir, f"packs-{grams}", make, ("documents", "benchmark"))


_lexical = lambda r: np.where(r.bm25 > 0, r.bm25, -np.inf)


def _best_bm25(spark, sf_dir, k: int) -> DataFrame:
    """(query_id, chunk_id, bm25, rank) of the best k of each question."""
    if not _own_ids(spark, sf_dir):
        return lexical.top(_bm25(spark, sf_dir), k, "bm25").select("query_id", "chunk_id", "bm25", "rank")
    return lexical.top(packs.best(_packs(spark, sf_dir), [(_lexical, k)], scaled=False), k, "bm25").select("query_id", "chunk_id", "bm25", "rank")


def _bm25_ends(spark, sf_dir) -> DataFrame:
    """(query_id, matched, best, mean) of the BM25 scores of each question."""
    if not _own_ids(spark, sf_dir):
        return _bm25(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("matched"), F.max("bm25").alias("best"), F.avg("bm25").alias("mean"))
    return packs.ends(_packs(spark, sf_dir)).where("bn > 0").select("query_id", F.col("bn").alias("matched"), F.col("bhi").alias("best"), (F.col("bsum") / F.col("bn")).alias("mean"))


def _bm25(spark, sf_dir, **kw) -> DataFrame:
    return lexical.bm25(_index(spark, sf_dir), _questions(spark, sf_dir), **kw)


@query(f"WITH {_INDEX} SELECT term, doc_id AS chunk_id, tf FROM post")
def postings(spark, sf_dir):
    return lexical.build_index(_cleaned(spark, sf_dir)).postings


@query(f"WITH {_INDEX} SELECT term, df FROM dfreq")
def document_frequency(spark, sf_dir):
    return lexical.build_index(_cleaned(spark, sf_dir)).frequencies


@query(f"WITH {_INDEX} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, max(tf) AS most FROM post GROUP BY 1")
def term_frequency(spark, sf_dir):
    return lexical.terms_of(_cleaned(spark, sf_dir), "doc_id", "clean").groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("most"))


@query(f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM tot")
def bm25_totals(spark, sf_dir):
    return lexical.build_index(_cleaned(spark, sf_dir)).totals.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_BM25} SELECT query_id, count(*) AS matched, round(max(bm25), 6) AS best, round(avg(bm25), 6) AS mean FROM bm GROUP BY 1")
def bm25_scores(spark, sf_dir):
    return _bm25_ends(spark, sf_dir).select("query_id", "matched", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round({0}, 9) DESC, {1})"


@query(f"WITH {_BM25}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} AS rank FROM bm) SELECT query_id, doc_id AS chunk_id, round(bm25, 6) AS bm25, rank::INT AS rank FROM r WHERE rank <= 5")
def bm25_batch(spark, sf_dir):
    return _best_bm25(spark, sf_dir, 5).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"WITH {_INDEX}, raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfreq, tot) SELECT term, round(CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END, 6) AS idf FROM (SELECT term, idf, avg(idf) OVER () AS mean FROM raw)")
def bm25_classic_idf(spark, sf_dir):
    return lexical.idf_table(lexical.build_index(_cleaned(spark, sf_dir)), "okapi").select("term", F.round("idf", 6).alias("idf"))


def _gram_sql(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(list_concat(g, CASE WHEN len(g) < 2 THEN [] ELSE list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]) END)) AS term FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]{{2,}}') AS g FROM {table})"


_TFIDF = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_gram_sql('documents', 'doc_id')}) GROUP BY ALL), nn AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), nn),
rw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM rw GROUP BY 1),
qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM ({_gram_sql('benchmark', 'item_id')}) GROUP BY ALL),
qw AS (SELECT query_id, term, tf * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
tfs AS (SELECT query_id, doc_id, sum(rw.w / nrm.norm * (qw.w / qn.norm)) AS cosine FROM rw JOIN nrm USING (doc_id) JOIN qw USING (term) JOIN qn USING (query_id) GROUP BY ALL)"""


def _tfidf(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    counts = _kept(spark, sf_dir, "grams", lambda: lexical.gram_counts(docs, "doc_id", "text"))
    return lexical.tfidf_cosine(docs, _questions(spark, sf_dir), "doc_id", "text", counts=counts).withColumnRenamed("doc_id", "chunk_id")


_nearest = lambda r: np.where(r.dense > 0, r.dense, -np.inf)


def _cosines(spark, sf_dir, k: int) -> DataFrame:
    """(query_id, chunk_id, cosine): all, or at least those that can be among the best k of a question."""
    if not _own_ids(spark, sf_dir):
        return _tfidf(spark, sf_dir)
    return packs.best(_packs(spark, sf_dir, grams=True), [(_nearest, k)], scaled=False).select("query_id", "chunk_id", F.col("dense").alias("cosine"))


@query(f"WITH {_TFIDF}, r AS (SELECT *, {_TOP.format('cosine', 'doc_id')} AS rank FROM tfs) SELECT query_id, doc_id AS chunk_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM r WHERE rank <= 5")
def tfidf_cosine(spark, sf_dir):
    return lexical.top(_cosines(spark, sf_dir, 5), 5, "cosine").select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), "rank")


# --- dense -----------------------------------------------------------------------------------------------------------

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _asked(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, {_TOP.format('score', 'vec_id')} AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def vector_batch_topk(spark, sf_dir):
    return dense.batch_topk(_read(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH s AS (SELECT b.vec_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    one = dense.batch_topk(v, v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return one.select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n, round(max(abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)), 6) AS worst FROM embeddings")
def vector_norm_check(spark, sf_dir):
    return dense.norm_error(_read(spark, sf_dir, "embeddings")).select("n", F.round("worst", 6).alias("worst"))


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0), r AS (SELECT *, {_TOP.format('score', 'vec_id')} AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def vector_restricted_topk(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumnRenamed("embedding", "q")
    rows = _read(spark, sf_dir, "embeddings").join(asked, "label").select("query_id", "vec_id", dense.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return lexical.top(rows, 5, "score", "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(ORACLE["vector_batch_topk"])
def ivf_topk(spark, sf_dir):
    """The cell index, written, read and searched; its bound makes it exact."""
    index = dense.write_cells(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), new_path(spark, "cells"))
    return dense.cell_topk(index, _asked(spark, sf_dir), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH s AS (SELECT b.vec_id AS chunk_id, min({_DOT}) AS lo, max({_DOT}) AS hi FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0 GROUP BY 1) SELECT chunk_id AS query_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s")
def vector_bounds(spark, sf_dir):
    ends = dense.bounds(_read(spark, sf_dir, "embeddings"), _asked(spark, sf_dir))
    return ends.select("query_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("SELECT vec_id AS chunk_id, vec_id < 300 AS kept, round(sqrt(CASE WHEN vec_id < 300 THEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) ELSE 1.0 END), 4) AS norm FROM embeddings")
def appended_vectors(spark, sf_dir):
    """Vectors at hand stay as they are; rows without one are encoded."""
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("row"), "vec_id").alias("text"))
    out = dense.appended(v.where("chunk_id < 300"), v)
    same = out.join(v.select("chunk_id", F.col("embedding").alias("old")), "chunk_id")
    return same.select("chunk_id", (F.col("embedding") == F.col("old")).alias("kept"), F.round(F.sqrt(dense.cosine(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@query()
def encode_documents(spark, sf_dir):
    return dense.encode(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "embedding")


# --- grounding -------------------------------------------------------------------------------------------------------

QUESTIONS = (
    (1, "What are the side effects of the blue anvil?"),
    (2, "how does zorbex work with a cold gizmo"),
    (3, "What is the dosage of Skyplate?"),
    (4, "tell me about side effects"),
    (5, "does flurbex interact with glonk"),
    (6, "Is AZUL-widget safe to take with ring?"),
    (7, "what is the mechanism of action of the bolt and how does it work"),
    (8, "how much of the gear should patients take per day, 500 mg bid?"),
    (9, "who should not take red rod during pregnancy"),
    (10, None),
)
BRANDS = (("skyplate", "plate", "resolve"), ("zorbex", "zorbium", "absent"), ("flurbex", "blue mix", "combination"), ("azul-widget", "widget", "resolve"), ("glonk", "nowhere", "resolve"))


def _inline(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id bigint, query string")


def _brands(spark) -> DataFrame:
    return spark.createDataFrame(BRANDS, "brand string, generic string, kind string")


_DROP = list(dict.fromkeys((*lists.STOP_WORDS, *lists.QUESTION_WORDS, *lists.SALT_WORDS)))
_GROUND = f"""qs(query_id, query) AS (SELECT * FROM {_values(QUESTIONS)}), vocab AS (SELECT DISTINCT unnest({_ID.format('p_name')}) AS token FROM part),
br(brand, generic, kind) AS (SELECT * FROM {_values(BRANDS)}),
al AS (SELECT query_id, list_filter(regexp_extract_all(lower(coalesce(query, '')), '[a-z][a-z\\-]{{2,}}'), lambda x: NOT list_contains({_sql_list(_DROP)}, x)) AS ts FROM qs),
tm AS (SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM al) GROUP BY ALL),
gr AS (SELECT query_id, term, rank() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS position,
  CASE WHEN v.token IS NOT NULL THEN 'matched' WHEN br.kind = 'resolve' AND g.token IS NOT NULL THEN 'alias' ELSE 'unknown' END AS kind,
  CASE WHEN v.token IS NOT NULL THEN term WHEN br.kind = 'resolve' AND g.token IS NOT NULL THEN br.generic END AS entity,
  CASE WHEN v.token IS NULL AND br.kind <> 'resolve' THEN br.generic || ': ' || br.kind END AS note
  FROM tm LEFT JOIN vocab v ON v.token = term LEFT JOIN br ON br.brand = term LEFT JOIN vocab g ON g.token = br.generic)"""


def _grounded(spark, sf_dir) -> DataFrame:
    return grounding.ground(_inline(spark), grounding.vocabulary(_read(spark, sf_dir, "part"), "p_name"), _brands(spark))


@query(f"WITH {_GROUND} SELECT query_id, term, position::INT AS position, kind, entity, note FROM gr")
def ground_terms(spark, sf_dir):
    return _grounded(spark, sf_dir).select("query_id", "term", "position", "kind", "entity", "note")


@query(f"WITH {_GROUND} SELECT query_id, string_agg(term, ',' ORDER BY position) AS unknown FROM gr WHERE kind = 'unknown' GROUP BY 1")
def unknown_terms(spark, sf_dir):
    out = grounding.outcomes(_inline(spark), _grounded(spark, sf_dir))
    return out.where(F.size("unknown") > 0).select("query_id", F.array_join("unknown", ",").alias("unknown"))


@query(f"""
WITH {_GROUND}, h AS (SELECT *, string_split(generic, ' ')[1] AS head FROM br),
one AS (SELECT t[1] AS token, min_by(name, (length(name), name)) AS name FROM (SELECT trim(p_type) AS name, {_ID.format('p_type')} AS t FROM part) WHERE len(t) = 1 GROUP BY 1),
anyt AS (SELECT DISTINCT unnest({_ID.format('p_type')}) AS token FROM part), bb(brand, generic) AS (SELECT * FROM (VALUES ('a', 'economy'), ('b', 'promo pack'), ('c', 'nothing')))
SELECT brand, CASE WHEN one.token IS NOT NULL THEN string_split(generic, ' ')[1] ELSE generic END AS generic, one.name AS record,
  CASE WHEN one.token IS NOT NULL THEN 'resolve' WHEN anyt.token IS NOT NULL THEN 'combination' ELSE 'absent' END AS kind
FROM bb LEFT JOIN one ON one.token = string_split(generic, ' ')[1] LEFT JOIN anyt ON anyt.token = string_split(generic, ' ')[1]""")
def brand_resolution(spark, sf_dir):
    wanted = spark.createDataFrame([("a", "economy"), ("b", "promo pack"), ("c", "nothing")], "brand string, generic string")
    return grounding.brand_map(wanted, _read(spark, sf_dir, "part"), "p_type")


@query(f"""
WITH {_GROUND} SELECT query_id, list_aggregate(list_sort(list_distinct(list(entity) FILTER (kind <> 'unknown'))), 'string_agg', ',') AS matched,
  count(*) FILTER (kind = 'alias') AS n_aliases FROM gr GROUP BY 1""")
def matched_entities(spark, sf_dir):
    out = grounding.outcomes(_inline(spark), _grounded(spark, sf_dir)).where((F.size("matched") > 0) | (F.size("unknown") > 0))
    return out.select("query_id", F.nullif(F.array_join("matched", ","), F.lit("")).alias("matched"), F.size("aliases").cast("long").alias("n_aliases"))


@query(rf"""
WITH {_GROUND}, ps AS (SELECT query_id, list(term || '=>' || entity ORDER BY position) AS pairs FROM gr WHERE kind = 'alias' GROUP BY 1)
SELECT query_id::INT AS query_id, list_reduce(list_prepend(query, pairs), lambda said, p: regexp_replace(said, '\b' || split_part(p, '=>', 1) || '\b', split_part(p, '=>', 2), 'gi')) AS rewritten FROM qs JOIN ps USING (query_id)""")
def alias_rewrite(spark, sf_dir):
    out = grounding.outcomes(_inline(spark), _grounded(spark, sf_dir)).where(F.size("aliases") > 0)
    return out.select(F.col("query_id").cast("int").alias("query_id"), "rewritten")


@query()
def fuzzy_suggestions(spark, sf_dir):
    asked = spark.createDataFrame([("wigdet",), ("anvill",), ("qqqq",), ("plat",)], "term string")
    return grounding.suggestions(asked, grounding.vocabulary(_read(spark, sf_dir, "part"), "p_name"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z\\-]{2,}')"
_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz-', ''), lambda c: length({0}) - length(replace({0}, c, '')))"


@query(f"""
WITH RECURSIVE vocab AS (SELECT w AS token, {_LETTERS.format('w')} AS cs FROM (SELECT unnest({_TOKENS}) AS w FROM documents) GROUP BY w HAVING count(*) >= 20),
asked AS (SELECT w AS term, {_LETTERS.format('w')} AS cs FROM (SELECT DISTINCT unnest({_TOKENS}) AS w FROM benchmark) WHERE w NOT IN (SELECT token FROM vocab)),
close AS (SELECT term, token FROM asked a, vocab v WHERE 2 * list_sum(list_transform(list_zip(a.cs, v.cs), lambda z: least(z[1], z[2]))) >= 0.82 * (length(term) + length(token))),
todo AS (
  SELECT term, token, 0::BIGINT AS alo, length(token) AS ahi, 0::BIGINT AS blo, length(term) AS bhi, 0::BIGINT AS k FROM close
  UNION ALL
  SELECT term, token, side.alo, side.ahi, side.blo, side.bhi, side.k FROM (
    SELECT term, token, unnest([{{'alo': alo, 'ahi': -best.i, 'blo': blo, 'bhi': blo - best.j - 1, 'k': best.k}}, {{'alo': best.k - best.i, 'ahi': ahi, 'blo': blo - best.j - 1 + best.k, 'bhi': bhi, 'k': 0}}]) AS side FROM (
      SELECT *, list_max(list_filter(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(1, ahi - i + 1), lambda n: {{'k': n, 'i': -i, 'j': -instr(substr(term, blo + 1, bhi - blo), substr(token, i + 1, n))}}))), lambda x: x.j < 0)) AS best
      FROM todo WHERE alo < ahi AND blo < bhi) WHERE best IS NOT NULL)),
scored AS (SELECT term, token, 2.0 * sum(k) / (length(term) + length(token)) AS ratio FROM todo GROUP BY term, token)
SELECT term, max({{'r': ratio, 't': token}}).t AS match, max(ratio)::DOUBLE AS ratio FROM scored WHERE ratio >= 0.82 GROUP BY term""")
def word_suggestions(spark, sf_dir):
    """For the benchmark's words that the documents hardly have, the nearest of their usual words."""
    words = lambda t: _read(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z-]{2,})"), F.lit(1))).alias("token"))
    usual = stored(words("documents").groupBy("token").agg(F.count("*").alias("n")).where("n >= 20").select("token"), "usual")
    asked = words("benchmark").distinct().join(usual, "token", "left_anti").select(F.col("token").alias("term"))
    return grounding.suggestions(asked, usual)


# --- hybrid ----------------------------------------------------------------------------------------------------------

_BOTH = _BM25 + ", " + _TFIDF.replace("tf AS (", "tf2 AS (", 1).replace("FROM tf GROUP", "FROM tf2 GROUP").replace("FROM tf JOIN", "FROM tf2 JOIN")
_BLEND = _BOTH + """,
bb AS (SELECT query_id, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN least(min(bm25), 0) ELSE min(bm25) END AS blo, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN greatest(max(bm25), 0) ELSE max(bm25) END AS bhi FROM bm GROUP BY 1),
cb AS (SELECT query_id, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN least(min(cosine), 0) ELSE min(cosine) END AS clo, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN greatest(max(cosine), 0) ELSE max(cosine) END AS chi FROM tfs GROUP BY 1),
al2 AS (SELECT coalesce(bm.query_id, tfs.query_id) AS query_id, coalesce(bm.doc_id, tfs.doc_id) AS doc_id, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS dense FROM bm FULL JOIN tfs ON bm.query_id = tfs.query_id AND bm.doc_id = tfs.doc_id),
mix AS (SELECT al2.*, 0.2 * CASE WHEN bhi - blo < 1e-12 THEN 0.5 ELSE (bm25 - blo) / (bhi - blo) END + 0.8 * CASE WHEN chi - clo < 1e-12 THEN 0.5 ELSE (dense - clo) / (chi - clo) END AS score FROM al2 JOIN bb USING (query_id) JOIN cb USING (query_id))"""


ALPHA = 0.2
_floored = lambda r, score: np.where(r.floor(), score, -np.inf)


def _scaled(spark, sf_dir, rankings: list[tuple[packs.Ranking, int]]) -> DataFrame:
    """The rows of hybrid.scale: all, or at least those that can be among the best of the rankings."""
    if not _own_ids(spark, sf_dir):
        return hybrid.scale(_bm25(spark, sf_dir), _tfidf(spark, sf_dir).withColumnRenamed("cosine", "dense"), _cleaned(spark, sf_dir))
    return stored(packs.best(_packs(spark, sf_dir, grams=True), rankings).drop("win"), "scaled")


def _blended(spark, sf_dir, *rankings: tuple[packs.Ranking, int]) -> DataFrame:
    score = ALPHA * F.col("lexical_part") + (1 - ALPHA) * F.col("dense_part")
    return _scaled(spark, sf_dir, list(rankings)).select("query_id", "chunk_id", "bm25", "dense", score.alias("score"))


@query(f"WITH {_BLEND} SELECT query_id, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM mix GROUP BY 1")
def minmax_blend(spark, sf_dir):
    if _own_ids(spark, sf_dir):
        return packs.blended(_packs(spark, sf_dir, grams=True), ALPHA).select("query_id", "n", F.round("best", 6).alias("best"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))
    return _blended(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {_BLEND}, r AS (SELECT *, {_TOP.format('score', 'doc_id')} AS rank FROM mix WHERE dense >= 0.25 OR bm25 >= 1.0) SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5")
def hybrid_topk(spark, sf_dir):
    return hybrid.ranked(_blended(spark, sf_dir, (lambda r: _floored(r, r.blend(ALPHA)), 5)), 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_BLEND}, bo AS (SELECT query_id, doc_id, bm25, dense, score * CASE lang WHEN 'fr' THEN 1.2 WHEN 'de' THEN 1.1 ELSE 1.0 END AS score FROM mix JOIN documents USING (doc_id)),
r AS (SELECT *, {_TOP.format('score', 'doc_id')} AS rank FROM bo WHERE dense >= 0.25 OR bm25 >= 1.0) SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def field_boost_topk(spark, sf_dir):
    weights = _questions(spark, sf_dir).select("query_id", F.explode(F.array(F.struct(F.lit("fr").alias("field"), F.lit(1.0).alias("weight")), F.struct(F.lit("de").alias("field"), F.lit(0.5).alias("weight")))).alias("x")).select("query_id", "x.*")
    factor = lambda r: np.where(r.has(1, "fr"), 1.2, np.where(r.has(1, "de"), 1.1, 1.0))
    boosted = hybrid.boost(_blended(spark, sf_dir, (lambda r: _floored(r, r.blend(ALPHA) * factor(r)), 5)), _cleaned(spark, sf_dir).select("chunk_id", "field"), weights)
    return hybrid.ranked(boosted, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_BLEND}, al3 AS (SELECT mix.*, source = 'src' || (query_id % 25) AS ok FROM mix JOIN documents USING (doc_id)), re AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM al3),
r AS (SELECT *, {_TOP.format('score', 'doc_id')} AS rank FROM re WHERE (ok OR NOT any_ok) AND (dense >= 0.25 OR bm25 >= 1.0)) SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def restricted_topk(spark, sf_dir):
    docs = _cleaned(spark, sf_dir)
    wanted = _questions(spark, sf_dir).select("query_id", F.concat(F.lit("src"), F.col("query_id") % 25).alias("token"))
    own = lambda r: r.has(0, f"src{int(math.fmod(r.query, 25))}")
    score = lambda r: r.blend(ALPHA)
    # one of a question's own, whatever its scores, tells that there are some
    rankings = (lambda r: np.where(own(r), score(r), -np.inf), 3), (lambda r: np.where(own(r), _floored(r, score(r)), -np.inf), 3), (lambda r: _floored(r, score(r)), 3)
    kept = hybrid.restrict(_blended(spark, sf_dir, *rankings), wanted, docs.select("chunk_id", F.col("title").alias("token")))
    return hybrid.ranked(kept, 3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_BLEND}, a AS (SELECT *, {_TOP.format('score', 'doc_id')} AS r1 FROM mix), p AS (SELECT query_id, doc_id, dense AS score FROM a WHERE r1 <= 40 AND (dense >= 0.25 OR bm25 >= 1.0)),
r AS (SELECT *, {_TOP.format('score', 'doc_id')} AS rank FROM p) SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def rerank_cascade(spark, sf_dir):
    return hybrid.reranked(_blended(spark, sf_dir, (lambda r: r.blend(ALPHA), 40)), 5, F.col("dense")).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_GROUND}, per AS (SELECT query_id, count(*) FILTER (kind <> 'unknown') AS m, count(*) FILTER (kind = 'unknown') AS u FROM gr GROUP BY 1),
hit AS (SELECT query_id, p_name, count(*) AS bm25 FROM gr JOIN (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS word FROM part) ON word = entity GROUP BY ALL),
res AS (SELECT query_id, least(count(*), 3) AS n FROM hit WHERE bm25 >= 1.5 GROUP BY 1)
SELECT qs.query_id, CASE WHEN coalesce(m, 0) = 0 AND coalesce(u, 0) > 0 THEN 'unknown_entity' WHEN coalesce(m, 0) = 0 THEN 'no_entity' WHEN coalesce(n, 0) = 0 THEN 'no_relevant_context' ELSE 'ok' END AS status,
  CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE coalesce(n, 0) END AS n_results FROM qs LEFT JOIN per USING (query_id) LEFT JOIN res USING (query_id)""")
def floor_abstain_status(spark, sf_dir):
    """Names score by the matched terms they hold; the floor takes those with one term, and a query left with none says so."""
    grounded = _grounded(spark, sf_dir)
    names = _read(spark, sf_dir, "part").select("p_name").distinct()
    hits = grounded.where("kind <> 'unknown'").join(names.withColumn("entity", F.explode(F.array_distinct(F.split("p_name", " ")))), "entity")
    scored = hits.groupBy("query_id", F.col("p_name").alias("chunk_id")).agg(F.count("*").cast("double").alias("bm25")).withColumn("dense", F.lit(None).cast("double")).withColumn("score", F.col("bm25"))
    out = hybrid.statuses(grounding.outcomes(_inline(spark), grounded), hybrid.ranked(scored, 3, lex=1.5))
    return out.select("query_id", "status", "n_results")


@query(f"""
WITH {_BLEND}, r AS (SELECT *, {_TOP.format('score', 'doc_id')} AS rank FROM mix), s AS (SELECT *, greatest(0.2 * bm25 + 0.8 * dense, 1e-9) AS tot FROM r WHERE rank <= 3)
SELECT query_id, doc_id AS chunk_id, round(0.2 * bm25 / tot, 6) AS lexical_share, round(0.8 * dense / tot, 6) AS dense_share FROM s""")
def score_shares(spark, sf_dir):
    best = lexical.top(_blended(spark, sf_dir, (lambda r: r.blend(ALPHA), 3)), 3, "score")
    out = best.select("query_id", "chunk_id", *hybrid.shares(0.2))
    return out.select("query_id", "chunk_id", F.round("lexical_share", 6).alias("lexical_share"), F.round("dense_share", 6).alias("dense_share"))


@query(f"""
WITH {_BLEND}, a AS (SELECT query_id, doc_id FROM (SELECT *, {_TOP.format('bm25', 'doc_id')} AS rank FROM bm) WHERE rank <= 5), b AS (SELECT query_id, doc_id FROM (SELECT *, {_TOP.format('cosine', 'doc_id')} AS rank FROM tfs) WHERE rank <= 5)
SELECT query_id, doc_id AS chunk_id, 'only_a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT query_id, doc_id, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT query_id, doc_id, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def result_set_diff(spark, sf_dir):
    if _own_ids(spark, sf_dir):
        rows = stored(packs.best(_packs(spark, sf_dir, grams=True), [(_lexical, 5), (_nearest, 5)], scaled=False), "both-best")
        a, b = rows.where("bm25 > 0"), rows.where("dense > 0").withColumnRenamed("dense", "cosine")
    else:
        a, b = _bm25(spark, sf_dir), _tfidf(spark, sf_dir)
    return hybrid.differences(lexical.top(a, 5, "bm25").select("query_id", "chunk_id"), lexical.top(b, 5, "cosine").select("query_id", "chunk_id"))


# --- intents and personas --------------------------------------------------------------------------------------------

_SCORES = ", ".join(f"({k}, '{i}', {w}, '{p.replace(chr(39), chr(39) * 2)}')" for k, (i, w, p) in enumerate(lists.INTENT_RULES))
#: What users of the conversations ask, after a form that their place chooses; {} is the first word they said.
FORMS = (
    "What are the side effects of {}?", "how does {} work with a cold gizmo", "What is the dosage of {}?", "tell me about {}", "does {} interact with glonk",
    "Is {} safe to take with ring?", "what is the mechanism of action of {} and how does it work", "how much {} should patients take per day, 500 mg bid?",
    "who should not take {} during pregnancy", "I have chest pain since {}", "should I increase my dose of {}?", "what is {} used for?", "can I just stop {}",
    "where is {} stored and what is its half-life", "", "is too much {} harmful, or an OVERDOSE?", "I feel dizzy after {} and passed out",
)
_FIRST = "regexp_extract(lower(coalesce(text, '')), '[a-z]+')"
_FORMS_SQL = f"qs AS (SELECT conv_id * 1000 + turn AS query_id, replace({_sql_list(FORMS)}[(conv_id * 7 + turn * 3) % {len(FORMS)} + 1], '{{}}', {_FIRST}) AS query FROM conversations WHERE role = 'user')"


def _chosen(forms: tuple, by: int = 7) -> Column:
    """The form that a turn's place chooses."""
    return F.element_at(F.array(*map(F.lit, forms)), ((F.col("conv_id") * by + F.col("turn") * 3) % len(forms) + 1).cast("int"))


def _asked_turns(spark, sf_dir) -> DataFrame:
    first = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+", 0)
    turns = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.replace(_chosen(FORMS), F.lit("{}"), first).alias("query"))


_INTENTS = f"""{_FORMS_SQL}, rules(k, intent, w, p) AS (VALUES {_SCORES}),
hit AS (SELECT query_id, intent, sum(w::DOUBLE) AS w, min(k) AS k FROM qs JOIN rules ON regexp_matches(query, p, 'i') GROUP BY ALL),
dist AS (SELECT query_id, intent, round(w / sum(w) OVER (PARTITION BY query_id), 4) AS confidence, k FROM hit)"""


@query(f"WITH {_INTENTS} SELECT query_id, intent, confidence FROM dist")
def intent_distribution(spark, sf_dir):
    return routing.intent_rows(_asked_turns(spark, sf_dir))


@query(f"WITH {_INTENTS} SELECT query_id, arg_min(intent, (-confidence, k)) AS intent FROM dist GROUP BY 1")
def top_intents(spark, sf_dir):
    return _asked_turns(spark, sf_dir).select("query_id", routing.top_intent(routing.intents(F.col("query"))).alias("intent")).where("intent is not null")


@query(f"""
WITH {_GROUND}, {_INTENTS[_INTENTS.index('rules(k'):]}, per AS (SELECT query_id, list_sort(list_distinct(list(entity) FILTER (kind <> 'unknown'))) AS entities, string_agg(term, ',' ORDER BY position) FILTER (kind = 'unknown') AS unknown FROM gr GROUP BY 1),
di AS (SELECT query_id, count(*) AS n_intents, round(max(confidence), 4) AS best FROM dist GROUP BY 1)
SELECT qs.query_id, query AS raw, array_to_string(coalesce(entities, []), ',') AS entities, coalesce(unknown, '') AS unknown, coalesce(n_intents, 0) AS n_intents, best, coalesce(len(entities), 0) > 1 AS is_multi_drug FROM qs LEFT JOIN per USING (query_id) LEFT JOIN di USING (query_id)""")
def query_plans(spark, sf_dir):
    p = routing.plan(_inline(spark), grounding.outcomes(_inline(spark), _grounded(spark, sf_dir)))
    return p.select("query_id", "plan.raw", F.array_join("plan.entities", ",").alias("entities"), F.array_join("plan.unknown", ",").alias("unknown"), F.size("plan.intents").cast("long").alias("n_intents"), F.array_max(F.map_values("plan.intents")).alias("best"), "plan.is_multi_drug")


_FIELDS = f"fw(intent, field, weight) AS (SELECT * FROM {_values(lists.INTENT_FIELDS)})"
_ALLOWED = ", ".join(f"'{f}'" for f in sorted(routing.PATIENT.allowed))


@query(f"WITH {_INTENTS}, {_FIELDS} SELECT query_id, field, round(sum(confidence * weight), 6)::DOUBLE AS weight FROM dist JOIN fw USING (intent) WHERE field IN ({_ALLOWED}) GROUP BY ALL")
def patient_field_weights(spark, sf_dir):
    return routing.field_weights(_asked_turns(spark, sf_dir), routing.PATIENT).select("query_id", "field", F.round("weight", 6).alias("weight"))


_PICK = "s AS (SELECT vec_id % 7 AS query_id, vec_id AS chunk_id, 'drug-corpus' AS origin, ['description', 'mechanism', 'indications', 'dosage', 'side_effects', 'contraindications', 'interactions'][label % 7 + 1] AS field, embedding[1]::DOUBLE AS score FROM embeddings)"


def _candidates(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, lists.RECORD_FIELDS))
    return _read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("query_id"), F.col("vec_id").alias("chunk_id"), F.lit("drug-corpus").alias("origin"), F.element_at(names, (F.col("label") % 7 + 1).cast("int")).alias("field"), F.col("embedding")[0].cast("double").alias("score"))


@query(f"""
WITH {_PICK}, a AS (SELECT *, {_TOP.format('score', 'chunk_id')} AS r FROM s WHERE field IN ({_ALLOWED}))
SELECT query_id, chunk_id, field, row_number() OVER (PARTITION BY query_id ORDER BY CASE field WHEN 'contraindications' THEN 0 WHEN 'side_effects' THEN 1 WHEN 'description' THEN 2 WHEN 'indications' THEN 3 ELSE 9 END, r)::INT AS position FROM a WHERE r <= 4""")
def persona_select(spark, sf_dir):
    return routing.select_for(routing.PATIENT, _candidates(spark, sf_dir)).select("query_id", "chunk_id", "field", "position")


@query(f"WITH {_PICK}, a AS (SELECT *, {_TOP.format('score', 'chunk_id')} AS r FROM s WHERE field IN ({_ALLOWED})) SELECT query_id, string_agg(field, ',' ORDER BY field) AS dropped FROM (SELECT DISTINCT query_id, field FROM s EXCEPT SELECT DISTINCT query_id, field FROM a WHERE r <= 4) GROUP BY 1")
def dropped_fields(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return routing.dropped_fields(rows, routing.select_for(routing.PATIENT, rows)).select("query_id", F.array_join("dropped", ",").alias("dropped"))


@query(f"""
WITH {_INTENTS}, top AS (SELECT query_id, arg_min(intent, (-confidence, k)) AS intent FROM dist GROUP BY 1), rf(flag) AS (SELECT unnest({_sql_list(lists.RED_FLAGS)}))
SELECT qs.query_id, query, CASE WHEN EXISTS (SELECT 1 FROM rf WHERE contains(lower(query), flag)) THEN 'red_flag' WHEN regexp_matches(query, '{lists.MEDICATION_CHANGE.replace(chr(39), chr(39) * 2)}', 'i') THEN 'medication_change' WHEN intent = 'interactions' THEN 'interaction' END AS screen FROM qs LEFT JOIN top USING (query_id)""")
def persona_screens(spark, sf_dir):
    return _asked_turns(spark, sf_dir).select("query_id", "query", answers.screen(F.col("query"), routing.top_intent(routing.intents(F.col("query")))).alias("screen"))


# --- phrases ---------------------------------------------------------------------------------------------------------

_FIXED = tuple(dict.fromkeys((*lists.RED_FLAGS, *lists.INTERACTION_PHRASES, *lists.INTERACTION_WORDS)))
#: Three words from inside each question of the benchmark, and the fixed phrases of the screens after them.
_PHRASES_SQL = f"""phrases AS (SELECT item_id AS phrase_id, array_to_string(string_split(lower({FLAT.format('text')}), ' ')[3:5], ' ') AS phrase FROM benchmark
UNION ALL SELECT 1000000 + k, p FROM (SELECT unnest({_sql_list(_FIXED)}) AS p, unnest(range({len(_FIXED)})) AS k))"""


def _phrases(spark, sf_dir) -> DataFrame:
    inner = F.array_join(F.slice(F.split(F.lower(text.collapse(F.col("text"))), " "), 3, 3), " ")
    fixed = spark.createDataFrame([(1_000_000 + k, p) for k, p in enumerate(_FIXED)], "phrase_id bigint, phrase string")
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("phrase_id"), inner.alias("phrase")).unionByName(fixed)


_WHOLE = "NOT regexp_matches(substr(' ' || t, i, 1), '[\\p{L}\\p{N}]') AND NOT regexp_matches(substr(t || ' ', i + length(phrase), 1), '[\\p{L}\\p{N}]')"


@query(f"WITH {_PHRASES_SQL} SELECT doc_id, phrase_id, instr(t, phrase) - 1 AS first FROM (SELECT doc_id, lower(text) AS t FROM documents), phrases WHERE phrase <> '' AND contains(t, phrase)")
def phrase_hits(spark, sf_dir):
    return phrases.hits(_docs(spark, sf_dir), "doc_id", "text", _phrases(spark, sf_dir)).drop("n")


@query(f"""WITH {_FORMS_SQL}, {_PHRASES_SQL} SELECT query_id, phrase_id, len(places) AS n, places[1] - 1 AS first FROM (
  SELECT query_id, phrase_id, list_filter(range(1, length(t) - length(phrase) + 2), lambda i: substr(t, i, length(phrase)) = phrase AND {_WHOLE}) AS places
  FROM (SELECT query_id, lower(query) AS t FROM qs), phrases WHERE phrase <> '' AND contains(t, phrase)) WHERE len(places) > 0""")
def phrase_screens(spark, sf_dir):
    """The fixed phrases of the screens in what users ask, as whole words."""
    return phrases.hits(_asked_turns(spark, sf_dir), "query_id", "query", _phrases(spark, sf_dir), words=True)


# --- answers ---------------------------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, '(drug=' || source || ', field=' || lang || ', score=0.500)' || chr(10) || text AS tail FROM documents),
b AS (SELECT *, '[Source ' || rank || '] ' || tail AS block FROM o), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY rank) AS upto FROM b)
SELECT source AS query_id, count(*) AS n_sources, length(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS n_chars, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS digest FROM u WHERE rank = 1 OR upto <= 12000 GROUP BY 1""")
def pack_context(spark, sf_dir):
    from pyspark.sql import Window

    rows = _docs(spark, sf_dir).select(F.col("title").alias("query_id"), F.col("title").alias("drug"), "field", "text", F.lit(0.5).alias("score"), F.row_number().over(Window.partitionBy("title").orderBy("doc_id")).alias("rank"))
    return answers.packed(rows).select("query_id", "n_sources", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


_CW = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains(" + _sql_list(lists.OVERLAP_STOP_WORDS) + ", x))"


def _turns(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    c = _read(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("context", before).where("role = 'assistant'")


@query(f"""
WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations), a AS (SELECT conv_id, turn, {_CW.format('text')} AS ws, list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[a-z0-9]+')) AS ctx FROM c WHERE role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: list_contains(ctx, x))) / len(ws) END, 6)::DOUBLE AS overlap FROM a""")
def answer_overlap(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(text.overlap(F.col("text"), F.col("context")), 6).alias("overlap"))


#: What stands before and after an answer and before its context, with the number of its sources, by the turn's place.
SAID = (
    ("Take care [Source 1] and [Source 3]. This is NOT medical advice.", "", "alpha beta 12.5 mg", 2), ("No citation, 40 mg", "", "40 mg daily", 1),
    ("[Source 2][Source  2] fine 7 and 8.25", " [Source 1]", "fine 8.25", 2), ("<think>[Source 9]</think> ok [Source 1]", "", "", 1),
    ("<think>only this 3</think>", "", "7 times", 3), ("In 2 of 30 cases", " (see [Source 2], [Source 4])", "2 of 31", 4),
)
_SAID = f"""said AS (SELECT *, (conv_id * 5 + turn * 3) % {len(SAID)} + 1 AS f, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
a AS (SELECT conv_id, turn, {_sql_list([x[0] for x in SAID])}[f] || ' ' || text || {_sql_list([x[1] for x in SAID])}[f] AS answer, {_sql_list([x[2] for x in SAID])}[f] || ' ' || coalesce(before, '') AS context, {[x[3] for x in SAID]}[f] AS n FROM said WHERE role = 'assistant')"""


def _answers(spark, sf_dir) -> DataFrame:
    form = lambda k: _chosen(tuple(x[k] for x in SAID), 5)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.concat(form(0), F.lit(" "), "text", form(1)).alias("answer"), F.concat(form(2), F.lit(" "), F.coalesce("context", F.lit(""))).alias("context"), form(3).alias("n"))


@query(rf"""
WITH {_SAID}, u AS (SELECT conv_id, turn, n, trim(regexp_replace(answer, '<think>.*?</think>', '', 'gs')) AS said FROM a),
c AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(said, '\[Source\s+([0-9]+)\]', 1), lambda x: x::INT))) AS cited FROM u),
v AS (SELECT *, list_filter(cited, lambda x: x BETWEEN 1 AND n) AS good, list_filter(cited, lambda x: x NOT BETWEEN 1 AND n) AS bad FROM c)
SELECT conv_id, turn, array_to_string(good, ',') AS citations, array_to_string(bad, ',') AS invalid, contains(lower(said), 'not medical advice') AS has_disclaimer, len(good) > 0 AND len(bad) = 0 AS grounded FROM v""")
def citation_verify(spark, sf_dir):
    v = answers.verification(text.without_scratchpad(F.col("answer")), F.col("context"), F.col("n"))
    return _answers(spark, sf_dir).withColumn("v", v).select("conv_id", "turn", F.array_join(F.transform("v.citations", lambda x: x.cast("string")), ",").alias("citations"), F.array_join(F.transform("v.invalid", lambda x: x.cast("string")), ",").alias("invalid"), "v.has_disclaimer", "v.grounded")


@query(rf"""
WITH {_SAID}, n AS (SELECT conv_id, turn, regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?') AS x, regexp_extract_all(context, '[0-9]+(?:\.[0-9]+)?') AS y FROM a)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))), ',') AS unsupported FROM n""")
def unsupported_numbers(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(text.unsupported_numbers(F.col("answer"), F.col("context")), ",").alias("unsupported"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b', '[email]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\b\+?\d[\d\s().-]{7,}\d\b', '[phone]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '\b\d{3}-\d\d-\d{4}\b', '[id]', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '\b(mrn|nhs|patient\s*id|patient\s*no|patient\s*number)\s*[:#]?\s*\w+\b', '[record-id]', 'gi') AS t FROM c)
SELECT doc_id, md5(regexp_replace(t, '\b\d\d?[/-]\d\d?[/-]\d{2,4}\b', '[date]', 'g')) AS digest FROM d""")
def redact_pii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


@query("SELECT conv_id, turn, md5(text || CASE WHEN contains(lower(text), 'not medical advice') THEN '' ELSE chr(10) || chr(10) || '" + answers.DISCLAIMER + "' END) AS digest, substring(text, 1, 40) || CASE WHEN length(text) > 40 THEN '…' ELSE '' END AS snippet FROM conversations")
def disclaimers_and_snippets(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.with_disclaimer(F.col("text"), answers.DISCLAIMER)).alias("digest"), text.snippet(F.col("text"), 40).alias("snippet"))


@query(r"WITH c AS (SELECT doc_id, source || ' — ' || lang || ': ' || text AS text FROM documents) SELECT doc_id, md5(regexp_replace(text, '^.*? — .*?:\s*', '')) AS digest FROM c")
def prefix_strip(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("text", F.concat("title", F.lit(" — "), "field", F.lit(": "), "text"))
    return rows.select("doc_id", F.md5(text.without_prefix(F.col("text"))).alias("digest"))


#: Shorthand that stands before a turn's text, by its place.
NOTES = ("SOB and htn, 5 mg bid.", "  What about   (CKD)? ", "", "po prn!", "T2DM;uti", "GI (iv),")


@query(rf"""
WITH n AS (SELECT conv_id, turn, {_sql_list(NOTES)}[(conv_id * 7 + turn * 3) % {len(NOTES)} + 1] || ' ' || coalesce(text, '') AS note FROM conversations), ab(short, long) AS (SELECT * FROM {_values(lists.ABBREVIATIONS.items())}),
w AS (SELECT conv_id, turn, unnest(string_split({FLAT.format('lower(note)')}, ' ')) AS t, generate_subscripts(string_split({FLAT.format('lower(note)')}, ' '), 1) AS pos FROM n),
x AS (SELECT conv_id, turn, pos, t, regexp_replace(t, '^[.,;:?!()]+|[.,;:?!()]+$', '', 'g') AS bare FROM w)
SELECT conv_id, turn, string_agg(CASE WHEN long IS NULL THEN t ELSE replace(t, bare, long) END, ' ' ORDER BY pos) AS normalised FROM x LEFT JOIN ab ON short = bare GROUP BY 1, 2""")
def query_normalise(spark, sf_dir):
    note = F.concat(_chosen(NOTES), F.lit(" "), F.coalesce("text", F.lit("")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise(note).alias("normalised"))


@query("SELECT user_id, count(*) AS answers, count(*) FILTER (event_type <> 'view') AS refused, count(*) FILTER (event_type = 'click') AS grounded, count(DISTINCT event_type) AS personas FROM events GROUP BY 1")
def audit_rollup(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("persona"), F.when(F.col("event_type") == "view", "ok").otherwise("refused").alias("status"), F.when(F.col("event_type") == "click", "yes").otherwise("no").alias("grounded"))
    return answers.audit_rollup(e, "user_id")


@query("SELECT count(*) AS answers, count(*) FILTER (event_type <> 'ok') AS refused, count(*) FILTER (value > 50) AS grounded, count(DISTINCT user_id) AS personas FROM events")
def audit_metrics(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.when(F.col("value") > 50, "yes").otherwise("no").alias("grounded"), F.col("user_id").alias("persona"))
    return answers.audit_rollup(e)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def audit_stream_windows(spark, sf_dir):
    from ledgerwell.streaming import audit

    out = audit.windowed(_read(spark, sf_dir, "events"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


# --- pairs -----------------------------------------------------------------------------------------------------------

_PAIRS = """li AS (SELECT DISTINCT l_orderkey, p_name, CASE l_returnflag WHEN 'A' THEN 'Minor' WHEN 'N' THEN 'Moderate' ELSE 'odd' END AS level FROM lineitem JOIN part ON p_partkey = l_partkey),
pr AS (SELECT least(a.p_name, b.p_name) AS a, greatest(a.p_name, b.p_name) AS b, max(CASE a.level WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END) AS rank FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.p_name < b.p_name GROUP BY ALL)"""


def _pair_rows(spark, sf_dir) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "A", "Minor").when(F.col("l_returnflag") == "N", "Moderate").otherwise("odd")
    li = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_name", level.alias("level")).distinct()
    a, b = li.select("l_orderkey", F.col("p_name").alias("a_name"), "level"), li.select("l_orderkey", F.col("p_name").alias("b_name"))
    return a.join(b, "l_orderkey").where("a_name < b_name").withColumn("ord", F.struct(F.lit("f").alias("file"), F.col("l_orderkey").alias("row")))


@query(f"WITH {_PAIRS} SELECT a, b, CASE rank WHEN 2 THEN 'Moderate' WHEN 1 THEN 'Minor' ELSE 'Unknown' END AS level, rank::INT AS rank FROM pr")
def pair_dedupe_max_severity(spark, sf_dir):
    return pairs.severest(_pair_rows(spark, sf_dir))


def _resolved(spark, sf_dir, column: str, inputs: DataFrame) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("tokens", F.array_sort(text.identity_tokens(F.col("name"), lists.PAIR_SALT_WORDS)))
    return pairs.resolve(inputs.select(F.col(column).alias("input")), p)


ASKED = (("Blue Anvil", "cold gizmo"), ("blue anvil", "BLUE ANVIL "), ("anvil blue tablets", "red rod"), ("zorbium", "red rod"), ("plate", "small ring"))


@query(f"""
WITH {_PAIRS}, asked(input_a, input_b, ca, cb) AS (VALUES ('Blue Anvil', 'cold gizmo', 'blue anvil', 'cold gizmo'), ('blue anvil', 'BLUE ANVIL ', 'blue anvil', 'blue anvil'), ('anvil blue tablets', 'red rod', 'blue anvil', 'red rod'), ('zorbium', 'red rod', NULL, 'red rod'), ('plate', 'small ring', 'hot plate', 'small ring'))
SELECT input_a, input_b, CASE WHEN ca IS NULL OR cb IS NULL THEN 'unknown_drug' WHEN ca = cb THEN 'same_drug' WHEN rank IS NULL THEN 'no_interaction' ELSE 'ok' END AS status, coalesce(rank, -1)::INT AS rank FROM asked LEFT JOIN pr ON pr.a = least(ca, cb) AND pr.b = greatest(ca, cb)""")
def pair_lookup_status(spark, sf_dir):
    asked = spark.createDataFrame(ASKED, "input_a string, input_b string")
    names = asked.select(F.explode(F.array("input_a", "input_b")).alias("input"))
    out = pairs.check(asked, _resolved(spark, sf_dir, "input", names), pairs.severest(_pair_rows(spark, sf_dir)))
    return out.select("input_a", "input_b", "status", F.coalesce("rank", F.lit(-1)).alias("rank"))


@query("SELECT * FROM (VALUES ('Blue Anvil', 'blue anvil', 1), ('anvil blue tablets', 'blue anvil', 2), ('plate', 'hot plate', 3), ('cold gizmoo', 'cold gizmo', 5)) AS t(input, name, step)")
def name_resolution_ladder(spark, sf_dir):
    asked = spark.createDataFrame([("Blue Anvil",), ("anvil blue tablets",), ("plate",), ("cold gizmoo",), ("zorbium",), ("",)], "input string")
    return _resolved(spark, sf_dir, "input", asked)


@query(f"""
WITH {_PAIRS}, items AS (SELECT l_orderkey AS list_id, l_linenumber AS pos, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
ck AS (SELECT a.list_id, CASE WHEN a.p_name = b.p_name THEN 'same' WHEN pr.rank IS NULL THEN 'none' ELSE 'ok' END AS status, pr.rank FROM items a JOIN items b ON a.list_id = b.list_id AND a.pos < b.pos LEFT JOIN pr ON pr.a = least(a.p_name, b.p_name) AND pr.b = greatest(a.p_name, b.p_name)),
c AS (SELECT list_id, count(*) FILTER (status = 'ok' AND rank = 2) AS moderate, count(*) FILTER (status = 'ok' AND rank = 1) AS minor, count(*) FILTER (status = 'ok' AND rank = 0) AS unknown, count(*) FILTER (status = 'none') AS safe_pairs FROM ck GROUP BY 1)
SELECT list_id, count(*) AS n_drugs, 0::BIGINT AS major, coalesce(any_value(moderate), 0) AS moderate, coalesce(any_value(minor), 0) AS minor, coalesce(any_value(unknown), 0) AS unknown, coalesce(any_value(safe_pairs), 0) AS safe_pairs FROM items LEFT JOIN c USING (list_id) GROUP BY 1""")
def list_pairs_summary(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("input"))
    _, summary = pairs.check_lists(items, _resolved(spark, sf_dir, "input", items), pairs.severest(_pair_rows(spark, sf_dir)))
    return summary.select("list_id", "n_drugs", "major", "moderate", "minor", "unknown", "safe_pairs")


# --- evaluation ------------------------------------------------------------------------------------------------------

_TRUTH = "truth AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _truth(spark, sf_dir) -> DataFrame:
    """The documents that hold an item's whole text, as it stands: all items are one automaton, and each document is read once.
    An empty item is in every text."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    docs = _read(spark, sf_dir, "documents")
    found = phrases.hits(docs, "doc_id", "text", items, lower=False).select("doc_id", "phrase_id")
    everywhere = docs.where("text is not null").select("doc_id", F.lit("").alias("phrase")).join(items.where("phrase = ''"), "phrase")
    found = found.unionByName(everywhere.select("doc_id", "phrase_id"))
    return found.select(F.col("phrase_id").alias("query_id"), F.col("doc_id").alias("chunk_id")).distinct()


@query(f"""
WITH {_BM25}, {_TRUTH}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} AS rank FROM bm), f AS (SELECT query_id, min(rank) AS first_rank FROM truth JOIN r USING (query_id, doc_id) WHERE rank <= 20 GROUP BY 1), c AS (SELECT DISTINCT query_id FROM truth)
SELECT count(*) AS cases, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, round(avg(coalesce(1.0 / first_rank, 0.0)), 6)::DOUBLE AS mrr FROM c LEFT JOIN f USING (query_id)""")
def recall_and_mrr(spark, sf_dir):
    results = _best_bm25(spark, sf_dir, 20)
    out = evaluation.recall_mrr(_truth(spark, sf_dir), results, ["query_id", "chunk_id"])
    return out.select("cases", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(f"""
WITH {_BM25}, {_TRUTH}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} AS rank FROM bm), h AS (SELECT query_id, count(*) AS hits FROM (SELECT DISTINCT * FROM truth) JOIN r USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1), w AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT * FROM truth) GROUP BY 1)
SELECT round(avg(coalesce(hits, 0) / 5), 6) AS precision, round(avg(coalesce(hits, 0) / n), 6) AS recall, round(avg(CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate FROM w LEFT JOIN h USING (query_id)""")
def precision_recall_at_5(spark, sf_dir):
    results = _best_bm25(spark, sf_dir, 5).select("query_id", "chunk_id", "rank")
    out = evaluation.precision_at(_truth(spark, sf_dir), results, ["query_id", "chunk_id"])
    return out.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "hit_rate")))


@query(f"""
WITH {_BM25}, {_TRUTH}, s AS (SELECT item_id AS query_id, item_id NOT IN (SELECT query_id FROM truth) AS must_refuse, coalesce((SELECT max(bm25) FROM bm WHERE bm.query_id = item_id), 0) >= 60 AS ok FROM benchmark)
SELECT round(avg(CASE WHEN must_refuse THEN CASE WHEN ok THEN 0.0 ELSE 1.0 END END), 6)::DOUBLE AS refusal_accuracy, round(avg(CASE WHEN NOT must_refuse THEN CASE WHEN ok THEN 0.0 ELSE 1.0 END END), 6)::DOUBLE AS false_refusals FROM s""")
def refusal_accuracy(spark, sf_dir):
    best = _bm25_ends(spark, sf_dir).select("query_id", "best")
    known = _truth(spark, sf_dir).select("query_id").distinct().withColumn("known", F.lit(True))
    rows = _questions(spark, sf_dir).select("query_id").join(best, "query_id", "left").join(known, "query_id", "left")
    rows = rows.select(F.when(F.coalesce("best", F.lit(0.0)) >= 60, "ok").otherwise("refused").alias("status"), F.col("known").isNull().alias("must_refuse"))
    return evaluation.refusals(rows).select(F.round("refusal_accuracy", 6).alias("refusal_accuracy"), F.round("false_refusals", 6).alias("false_refusals"))


ALPHAS = (0.0, 0.2, 0.4, 0.6, 1.0)
_LAB = f"""{_BLEND}, part01 AS (SELECT mix.*, CASE WHEN bhi - blo < 1e-12 THEN 0.5 ELSE (bm25 - blo) / (bhi - blo) END AS lp, CASE WHEN chi - clo < 1e-12 THEN 0.5 ELSE (dense - clo) / (chi - clo) END AS dp FROM mix JOIN bb USING (query_id) JOIN cb USING (query_id)),
lab AS (SELECT alpha, query_id, doc_id, alpha * lp + (1 - alpha) * dp AS score FROM part01, (SELECT unnest({list(ALPHAS)})::DOUBLE AS alpha) WHERE dense >= 0.25 OR bm25 >= 1.0),
rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lab)"""


def _lab(spark, sf_dir, floor: bool = True) -> DataFrame:
    rankings = [(lambda r, a=a: _floored(r, r.blend(a)) if floor else r.blend(a), 5) for a in ALPHAS]
    return hybrid.lab(_scaled(spark, sf_dir, rankings), ALPHAS, 5, floor)


@query(f"WITH {_LAB} SELECT alpha, query_id, doc_id AS chunk_id, round(score, 6) AS score, rank::INT AS rank FROM rk WHERE rank <= 5")
def alpha_lab(spark, sf_dir):
    return _lab(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_LAB}, {_TRUTH}, tl AS (SELECT DISTINCT query_id, lang FROM truth JOIN documents USING (doc_id)), cases AS (SELECT DISTINCT query_id FROM truth), al AS (SELECT DISTINCT alpha FROM rk),
f AS (SELECT alpha, query_id, min(rank) AS first_rank FROM truth JOIN rk USING (query_id, doc_id) WHERE rank <= 5 GROUP BY ALL),
g AS (SELECT alpha, rk.query_id, min(rank) AS first_field FROM rk JOIN documents USING (doc_id) JOIN tl ON tl.query_id = rk.query_id AND tl.lang = documents.lang WHERE rank <= 1 GROUP BY ALL),
mm AS (SELECT alpha, avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall, avg(CASE WHEN first_field <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS field_recall, avg(coalesce(1.0 / first_rank, 0.0))::DOUBLE AS mrr FROM al CROSS JOIN cases LEFT JOIN f USING (alpha, query_id) LEFT JOIN g USING (alpha, query_id) GROUP BY 1)
SELECT alpha, round(recall, 6) AS recall, round(field_recall, 6) AS field_recall, round(mrr, 6) AS mrr FROM mm WHERE round(recall, 9) = (SELECT max(round(recall, 9)) FROM mm) ORDER BY round(field_recall, 9) DESC, round(mrr, 9) DESC, alpha LIMIT 1""")
def alpha_sweep_select(spark, sf_dir):
    """Recall of verbatim documents and of their language at five blends, and the blend that wins."""
    ranked, truth = stored(_lab(spark, sf_dir), "lab"), _truth(spark, sf_dir)
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "field")
    by_field = evaluation.sweep(truth.join(docs, "chunk_id").select("query_id", "field").distinct(), ranked.where("rank <= 1").join(docs, "chunk_id").select("alpha", "query_id", "field", "rank"), ["query_id", "field"], "alpha", 1)
    both = evaluation.sweep(truth, ranked, ["query_id", "chunk_id"], "alpha").join(by_field.select("alpha", F.col("recall").alias("field_recall")), "alpha")
    return evaluation.choose(both, "alpha").select("alpha", *(F.round(c, 6).alias(c) for c in ("recall", "field_recall", "mrr")))


@query(f"""
WITH {_BM25}, r AS (SELECT *, {_TOP.format('bm25', 'doc_id')} AS rank FROM bm), best AS (SELECT query_id, lang AS guess FROM r JOIN documents USING (doc_id) WHERE rank = 1), t AS (SELECT query_id, lang AS truth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM (SELECT item_id AS query_id, doc_id, lang FROM benchmark b JOIN documents d ON contains(d.text, b.text))) WHERE k = 1)
SELECT round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, count(*) FILTER (guess IS NULL) AS unmatched FROM t LEFT JOIN best USING (query_id)""")
def field_accuracy(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "field")
    guess = _best_bm25(spark, sf_dir, 1).join(docs, "chunk_id").select("query_id", F.col("field").alias("guess"))
    truth = _truth(spark, sf_dir).groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id")).join(docs, "chunk_id").select("query_id", F.col("field").alias("truth"))
    return evaluation.accuracy(truth.join(guess, "query_id", "left"), "truth", "guess").select(F.round("accuracy", 6).alias("accuracy"), "unmatched")


# --- end to end ------------------------------------------------------------------------------------------------------

_CHUNK_BM25 = f"""{_CHUNKS}, kc AS (SELECT *, row_number() OVER (ORDER BY doc_id, win) - 1 AS chunk_id, {FLAT.format(_LOWER)} AS lo FROM chunks),
kt AS (SELECT chunk_id, list_filter(regexp_extract_all(lo, '{_WORD}'), lambda x: NOT list_contains({_sql_list(_KEEP)}, x)) AS ws2 FROM kc),
post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ws2) AS term FROM kt) GROUP BY ALL), dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
dl AS (SELECT chunk_id, len(ws2) AS dl FROM kt), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), {_QUERY_CTE},
bm AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN dfreq USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), tot GROUP BY ALL),
r AS (SELECT *, {_TOP.format('bm25', 'chunk_id')} AS rank FROM bm WHERE bm25 >= 1.0),
bl AS (SELECT query_id, rank, bm25, '[Source ' || rank || '] (drug=' || drug || ', field=' || field || ', score=' || printf('%.3f', round(bm25, 9)) || ')' || chr(10) || text AS block FROM r JOIN kc USING (chunk_id) WHERE rank <= 5),
up AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM bl)"""


@query(f"""
WITH {_CHUNK_BM25} SELECT query_id, count(*) AS n_sources, round(max(bm25), 6) AS best, length(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS n_chars, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS digest
FROM up WHERE rank = 1 OR upto <= 12000 GROUP BY 1""")
def grounded_context(spark, sf_dir):
    """Documents to windows, index, scores, floor, top 5 and a packed context for every question."""
    docs, asked = _docs(spark, sf_dir), _questions(spark, sf_dir)
    chunks = chunking.chunk_table(docs, profile="stopwords")
    if _own_ids(spark, sf_dir):  # chunks rank by document and window; only the texts of the best are cut again
        none = F.array().cast("array<bigint>").alias("grams")
        rows = chunks.select(F.col("doc_id").alias("chunk_id"), "win", F.array().cast("array<string>").alias("tags"), packs.hashed(F.lit(""), F.col("clean"))[0], none)
        held = packs.packs(rows, asked.select("query_id", packs.hashed(F.lit(""), F.col("clean"))[0], none), grams=False)
        scores = packs.best(held, [(lambda r: np.where(r.bm25 >= 1.0 - 1e-6, r.bm25, -np.inf), 5)], scaled=False).where("bm25 >= 1.0").withColumnRenamed("chunk_id", "doc_id")
        scores = stored(lexical.top(scores, 5, "bm25", F.struct("doc_id", "win")).select("query_id", "doc_id", "win", "bm25", "rank"), "scores")
        some = chunking.chunk_table(docs.join(scores.select("doc_id").distinct(), "doc_id", "left_semi"), profile="stopwords")
        best = stored(scores.join(some.select("doc_id", "win", "drug", "field", "text"), ["doc_id", "win"]), "best")
    else:
        chunks, asked = stored(chunking.numbered(chunks), "numbered"), stored(asked.select("query_id", "clean"), "questions")
        packed = shards.packed(lexical.build_index(chunks), terms=lexical.terms_of(asked, "query_id", "clean"))
        best = stored(shards.best(packed, asked, 5).where("bm25 >= 1.0").join(chunks.select("chunk_id", "drug", "field", "text"), "chunk_id"), "best")
    packed = answers.packed(best.withColumn("score", F.round("bm25", 9)))
    top = best.groupBy("query_id").agg(F.round(F.max("bm25"), 6).alias("best"))
    return packed.join(top, "query_id").select("query_id", "n_sources", "best", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


# --- the answer path over the tables ---------------------------------------------------------------------------------

#: What stands before and after a reply, by the turn's place: orders, advice and headings of a clinical answer.
REPLIES = (
    ("Take 2 tablets now. ", ""), ("You should  stop it ", " Ask your doctor or pharmacist."), ("Indication: ", ""), ("", " you may combine both  "),
    ("Dosing and INDICATION: ", " Contraindications: none"), (", ".join(lists.CLINICAL_HEADINGS) + " ", "   "), ("nothing of note ", ""),
)
_REPLIES = f"replies AS (SELECT conv_id, turn, {_sql_list([x[0] for x in REPLIES])}[f] || text || {_sql_list([x[1] for x in REPLIES])}[f] AS answer FROM (SELECT *, (conv_id * 5 + turn * 3) % {len(REPLIES)} + 1 AS f FROM conversations WHERE role = 'assistant'))"
_quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""
WITH {_REPLIES}, framed AS (SELECT *, CASE WHEN regexp_matches(answer, '(?im){lists.DOSING_IMPERATIVE}') THEN rtrim(answer) || {_quoted(chr(10) * 2 + answers.ADVISORY)} ELSE answer END AS framed,
  list_filter({_sql_list(lists.CLINICAL_HEADINGS)}, lambda h: NOT contains(lower(answer), lower(h))) AS missing FROM replies)
SELECT conv_id, turn, md5(CASE WHEN contains(lower(framed), 'doctor or pharmacist') THEN framed ELSE rtrim(framed) || {_quoted(chr(10) * 2 + answers.ESCALATION)} END) AS plain,
  md5(CASE WHEN len(missing) IN (0, {len(lists.CLINICAL_HEADINGS)}) THEN answer ELSE rtrim(answer) || {_quoted(chr(10) * 2 + '---' + chr(10) + '**Not covered by the retrieved sections:** ')} || array_to_string(missing, ' · ') || {_quoted(chr(10) * 2 + answers.MISSING)} END) AS headed FROM framed""")
def answer_enforcement(spark, sf_dir):
    """Replies as a lay and as a clinical persona gives them."""
    form = lambda k: _chosen(tuple(x[k] for x in REPLIES), 5)
    rows = _read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(form(0), "text", form(1)).alias("answer"))
    return rows.select("conv_id", "turn", F.md5(answers.enforce_plain(F.col("answer"))).alias("plain"), F.md5(answers.enforce_headings(F.col("answer"))).alias("headed"))


@query(f"""
WITH q AS (SELECT conv_id, turn, ['unknown_entity', 'no_relevant_context', 'no_entity', 'ok'][(conv_id + turn) % 4 + 1] AS status, regexp_extract_all(lower(text), '[a-z]+')[1:2] AS unknown,
  regexp_extract_all(lower(text), '[a-z]+')[3:2 + conv_id % 3] AS matched, CASE WHEN turn % 3 = 1 THEN 'a → ' || role END AS suggestion FROM conversations)
SELECT conv_id, turn, CASE status WHEN 'unknown_entity' THEN 'No information on ' || array_to_string(unknown, ', ') || ' is held here.' || CASE WHEN suggestion IS NOT NULL THEN chr(10) || chr(10) || 'Closest match: ' || suggestion ELSE '' END
  WHEN 'no_relevant_context' THEN CASE WHEN len(matched) = 0 THEN 'That source' ELSE array_to_string(matched, ', ') END || ' is held here, but nothing relevant enough to this question.'
  WHEN 'no_entity' THEN 'Please name a drug in the question.' END || {_quoted(chr(10) * 2 + answers.DISCLAIMER)} AS message FROM q""")
def refusal_messages(spark, sf_dir):
    place = F.col("conv_id") + F.col("turn")
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    status = F.element_at(F.array(*map(F.lit, ("unknown_entity", "no_relevant_context", "no_entity", "ok"))), (place % 4 + 1).cast("int"))
    matched = F.slice(found, F.lit(3), (F.col("conv_id") % 3).cast("int"))
    suggestion = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("a → "), "role"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", answers.refusal(status, F.slice(found, 1, 2), matched, suggestion).alias("message"))


@query(f"""
WITH r AS (SELECT conv_id, turn + 1 AS rank, role, CASE WHEN length(trim(text)) > 400 THEN substr(trim(text), 1, 400) || '…' ELSE trim(text) END AS said, text FROM conversations),
c AS (SELECT conv_id, string_agg('[Source ' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM r GROUP BY 1)
SELECT conv_id, md5({_quoted(answers.QUOTED + chr(10) * 2)} || string_agg('**[Source ' || rank || '] ' || role || ' — side effects**  ' || chr(10) || said, chr(10) || chr(10) ORDER BY rank) || {_quoted(chr(10) * 2 + answers.DISCLAIMER)}) AS quoted,
  md5({_quoted(answers.RULES + chr(10) * 2 + '---' + chr(10) + 'CONTEXT:' + chr(10))} || any_value(context) || {_quoted(chr(10) + '---' + chr(10) * 2 + 'QUESTION: ')} || 'turn ' || conv_id || {_quoted(chr(10) * 2 + 'ANSWER (with [Source N] citations):')}) AS prompt
FROM r JOIN c USING (conv_id) GROUP BY conv_id""")
def quoted_and_prompted(spark, sf_dir):
    """Conversations as results: quoted as an extractive answer, and packed in a prompt."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("title"), F.lit("side_effects").alias("field"), "text")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("[Source "), x["rank"].cast("string"), F.lit("] "), x["text"]))
    context = rows.groupBy("query_id").agg(F.array_join(blocks, "\n").alias("context"))
    both = answers.quoted(rows).join(context, "query_id")
    return both.select(F.col("query_id").alias("conv_id"), F.md5("answer").alias("quoted"), F.md5(answers.prompt(F.col("context"), F.concat(F.lit("turn "), F.col("query_id").cast("string")))).alias("prompt"))


_CASES = f"""cases AS (SELECT ['ok', 'ok', 'red_flag', 'no_relevant_context'][user_id % 4 + 1] AS status, value > 50 AS drug_hit, {_sql_list(lists.RECORD_FIELDS)}[event_id % 7 + 1] AS field,
  nullif(event_id % 6, 0) AS first_rank, event_id % 500 AS context_chars, value AS ms, event_id % 5 = 0 AS must_refuse, event_type FROM events)"""


@query(f"""
WITH {_CASES}, c AS (SELECT *, NOT must_refuse AS asked, status <> 'ok' AS refused, status = 'red_flag' AS policy, field IN ({_ALLOWED}) AS may FROM cases)
SELECT count(*) FILTER (asked AND NOT refused) AS answered, count(*) FILTER (asked AND NOT refused AND may) AS in_policy, count(*) FILTER (asked AND NOT refused AND NOT may) AS out_of_policy,
  round(avg(drug_hit::INT) FILTER (asked AND NOT refused), 6) AS drug_recall, round(avg((first_rank IS NOT NULL)::INT) FILTER (asked AND NOT refused AND may), 6) AS field_recall,
  round(avg(coalesce(1.0 / first_rank, 0.0)) FILTER (asked AND NOT refused AND may), 6)::DOUBLE AS field_mrr, count(*) FILTER (asked AND policy) AS policy_refusals, count(*) FILTER (asked AND refused AND NOT policy) AS retrieval_misses,
  round(avg(refused::INT) FILTER (NOT asked), 6) AS refusal_accuracy, round(avg(context_chars) FILTER (asked AND NOT refused), 6) AS mean_context_chars, round(avg(ms) FILTER (asked), 4) AS mean_ms FROM c""")
def persona_measures(spark, sf_dir):
    """Events as the cases of a lay persona."""
    e, fields = _read(spark, sf_dir, "events"), F.array(*map(F.lit, lists.RECORD_FIELDS))
    status = F.element_at(F.array(*map(F.lit, ("ok", "ok", "red_flag", "no_relevant_context"))), (F.col("user_id") % 4 + 1).cast("int"))
    cases = e.select(status.alias("status"), (F.col("value") > 50).alias("drug_hit"), F.element_at(fields, (F.col("event_id") % 7 + 1).cast("int")).alias("field"), F.nullif(F.col("event_id") % 6, F.lit(0)).alias("first_rank"), (F.col("event_id") % 500).alias("context_chars"), F.col("value").alias("ms"), (F.col("event_id") % 5 == 0).alias("must_refuse"))
    out = evaluation.persona_metrics(cases, routing.PATIENT.allowed)
    exact = ("drug_recall", "field_recall", "field_mrr", "refusal_accuracy", "mean_context_chars")
    return out.select(*(F.round(c, 6).alias(c) if c in exact else F.round(c, 4).alias(c) if c == "mean_ms" else c for c in out.columns))


@query("SELECT event_type AS persona, count(*) AS answers, count(*) FILTER (value <= 50) AS refused, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def audit_log(spark, sf_dir):
    """Events as audit rows, appended to a log in two batches and read back."""
    path = new_path(spark, "audit")
    rows = _read(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("persona"), F.when(F.col("value") > 50, "ok").otherwise("refused").alias("status"))
    for part in (0, 1):
        answers.append_audit(rows.where(F.pmod(F.xxhash64("time"), F.lit(2)) == part), path)
    log = spark.read.parquet(path)
    return log.groupBy("persona").agg(F.count("*").alias("answers"), F.count_if(F.col("status") != "ok").alias("refused"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("SELECT p_name AS brand, min(p_type) AS generic, CASE WHEN min(p_size) % 3 = 0 THEN 'combination' WHEN min(p_size) % 3 = 1 THEN 'absent' ELSE 'resolve' END AS kind FROM part GROUP BY 1")
def brand_store(spark, sf_dir):
    """A brand map of the part names, written as one object and read back."""
    path, size = new_path(spark, "brands"), F.min("p_size") % 3
    kind = F.when(size == 0, "combination").when(size == 1, "absent").otherwise("resolve")
    brands = _read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("brand")).agg(F.min("p_type").alias("generic"), kind.alias("kind"), F.lit(None).cast("string").alias("record"))
    records.write_brands(brands, path)
    return records.read_brands(spark, path).select("brand", "generic", "kind")


@query("SELECT concat_ws(' | ', 'p_partkey: ' || p_partkey, 'p_name: ' || nullif(p_name, ''), 'p_brand: ' || CASE WHEN p_size % 5 <> 0 THEN p_brand END, 'p_size: ' || p_size) AS text, count(*) AS n FROM part GROUP BY 1")
def uploaded_rows(spark, sf_dir):
    """The part table as CSV files with empty cells, read as uploads."""
    path = new_path(spark, "csv")
    cells = [F.col("p_partkey"), F.col("p_name"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("p_brand"), F.col("p_size")]
    _read(spark, sf_dir, "part").select(*cells).repartition(4, "p_partkey").write.csv(path, header=True)
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect()]  # four files
    return uploads.tables(spark, files).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT 'name: ' || p_name || ' | size: ' || p_size || ' | old: ' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS text, count(*) AS n FROM part GROUP BY 1")
def uploaded_records(spark, sf_dir):
    """The part table as JSON files of lists, 500 parts each, read as uploads."""
    path = new_path(spark, "json")
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_size") > 25).alias("old"), F.array(F.lit(1)).alias("inner"), F.lit(" ").alias("blank"))
    lists_ = _read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("g")).agg(F.to_json(F.collect_list(item)).alias("value"))
    lists_.write.partitionBy("g").text(path)
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path).select("path").collect()]  # a file for 500 parts
    return uploads.json_files(spark, files).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT 'same' AS fingerprint, count(*) AS n, round(sum(embedding[1]), 4)::DOUBLE AS first FROM embeddings UNION ALL SELECT 'other', 0, NULL UNION ALL SELECT 'fewer', 0, NULL")
def vector_cache(spark, sf_dir):
    """Vectors kept beside what they belong to: read back under their fingerprint and count, and under no other."""
    path = new_path(spark, "vectors")
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    records.write_vectors(v, path, "same", "model")
    n, out = v.count(), None
    for name, asked, count in (("same", "same", n), ("other", "other", n), ("fewer", "same", n - 1)):
        held = records.cached_vectors(spark, path, asked, count)
        held = v.limit(0) if held is None else held
        row = held.agg(F.lit(name).alias("fingerprint"), F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT true AS whole, (SELECT count(*) FROM embeddings WHERE label = 0) = 0 AS part, (SELECT count(*) FROM embeddings) = 0 AS shifted")
def vector_alignment(spark, sf_dir):
    """Whether vectors belong to rows: all of them, those of some labels, and under other keys."""
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    found = [(dense.aligned(v, v, "chunk_id"), dense.aligned(v, v.where("label <> 0"), "chunk_id"), dense.aligned(v, v.withColumn("chunk_id", F.col("chunk_id") + 1), "chunk_id"))]
    return spark.createDataFrame(found, "whole boolean, part boolean, shifted boolean")


@query("""
WITH b AS (SELECT vec_id % 50 AS query_id, embedding[1]::DOUBLE AS score FROM embeddings), n AS (SELECT query_id, count(*) AS rows_in, count(*) FILTER (score > 0.05) AS rows_out FROM b GROUP BY 1),
t AS (SELECT query_id, array_to_string(list_transform(list_reverse_sort(list_distinct(list(round(score, 4))))[1:3], lambda x: printf('%.4f', x)), ',') AS top_scores FROM b WHERE score > 0.05 GROUP BY 1)
SELECT query_id, rows_in, rows_out, coalesce(top_scores, '') AS top_scores, 'kept ' || rows_out || ' of ' || rows_in || CASE WHEN rows_in > rows_out THEN ', dropped ' || (rows_in - rows_out) || ' below floor' ELSE '' END AS line FROM n LEFT JOIN t USING (query_id)""")
def trace_steps(spark, sf_dir):
    b = _read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("query_id"), F.col("embedding")[0].cast("double").alias("score"))
    rows = steps.step(1, "floor", b, b.where("score > 0.05"), "below floor")
    return rows.select("query_id", "rows_in", "rows_out", F.array_join(F.transform("top_scores", lambda x: F.format_string("%.4f", x)), ",").alias("top_scores"), steps.summary().alias("line"))


@query(f"WITH t AS (SELECT conv_id, turn, '[Source 1] ' || text || CASE WHEN turn % 2 = 0 THEN ' [Source 2]' ELSE '' END AS c FROM conversations), w AS (SELECT *, len(string_split({FLAT.format('c')}, ' ')) AS n FROM t) SELECT conv_id, turn, length(c) AS chars, n AS words, floor(n * 1.3)::BIGINT AS tokens, 1 + (turn % 2 = 0)::INT AS sources FROM w")
def context_sizes(spark, sf_dir):
    c = F.concat(F.lit("[Source 1] "), "text", F.when(F.col("turn") % 2 == 0, " [Source 2]").otherwise(""))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", steps.context_size(c).alias("s")).select("conv_id", "turn", "s.*")


@query(f"WITH {_FORMS_SQL} SELECT query_id, list_has_any(regexp_extract_all(lower(query), '[a-z]+'), {_sql_list(lists.INTERACTION_WORDS)}) OR {' OR '.join(f"contains(lower(query), '{p}')" for p in lists.INTERACTION_PHRASES)} AS asks FROM qs")
def interaction_questions(spark, sf_dir):
    return _asked_turns(spark, sf_dir).select("query_id", text.asks_interaction(F.col("query")).alias("asks"))


_TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '(\p{{L}}+|\P{{L}}+)'), lambda p: upper(p[1:1]) || lower(p[2:])), '')"


@query(f"""
WITH l AS (SELECT p_partkey AS arrival, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN nullif(trim(p_name || ' ' || p_partkey % 50), '') END, p_brand) AS raw, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Unclassified' END AS class,
  'Used for ' || p_type AS indications, CASE WHEN p_partkey % 5 <> 0 THEN 'Acts on ' || p_name END AS mechanism, CASE WHEN p_size > 10 THEN 'Take ' || p_size ELSE '' END AS dosage, CASE WHEN p_size % 2 = 0 THEN 'Noise of ' || p_brand ELSE '' END AS side_effects,
  CASE WHEN p_size % 3 = 0 THEN 'Not with ' || p_brand ELSE '' END AS contraindications, '' AS interactions, CASE WHEN p_partkey % 7 = 0 THEN 'About ' || p_name ELSE '' END AS description FROM part),
r AS (SELECT arrival, {_TITLE.format('raw')} AS name, {_TITLE.format('class')} AS category, indications, mechanism, dosage, side_effects, contraindications, interactions, CASE WHEN description = '' THEN left(indications, 600) ELSE description END AS description FROM l WHERE mechanism IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY arrival) AS k FROM r WHERE 3 + (dosage <> '')::INT + (side_effects <> '')::INT + (contraindications <> '')::INT >= 4)
SELECT name, category, indications, mechanism, dosage, side_effects, contraindications, interactions, description FROM k WHERE k = 1""")
def label_records(spark, sf_dir):
    """Parts as labels of a feed: the first record of each name, of labels that hold enough."""
    c, one = F.col, lambda ok, text_: F.when(ok, F.array(text_))
    fields = {
        "generic_name": one(c("p_partkey") % 4 != 0, F.concat_ws(" ", "p_name", c("p_partkey") % 50)), "brand_name": F.array("p_brand"), "pharm_class_epc": one(c("p_partkey") % 3 == 0, c("p_type")),
        "indications_and_usage": F.array(F.lit("Used"), F.lit(" for"), c("p_type")), "mechanism_of_action": one(c("p_partkey") % 5 != 0, F.concat(F.lit("Acts  on "), "p_name")),
        "dosage_and_administration": one(c("p_size") > 10, F.concat(F.lit("Take "), c("p_size").cast("string"))), "adverse_reactions": one(c("p_size") % 2 == 0, F.concat(F.lit("Noise of "), "p_brand")),
        "contraindications": one(c("p_size") % 3 == 0, F.concat(F.lit(" Not with "), "p_brand")), "description": one(c("p_partkey") % 7 == 0, F.concat(F.lit("About\n"), "p_name")),
    }
    held = (*labels.NAMES, *labels.CLASSES, *labels.LABEL_FIELDS.values())
    rows = _read(spark, sf_dir, "part").select(*(fields.get(n, F.lit(None).cast("array<string>")).alias(n) for n in held), F.col("p_partkey").alias("arrival"))
    return labels.records_from_labels(rows).drop("source")


_FIELD_WORDS = (("description", "is made by"), ("mechanism", "works by the mechanism of"), ("indications", "is indicated for"), ("dosage", "dose per day of"), ("side_effects", "has side effects like"), ("contraindications", "should not be used with"), ("interactions", "interacts with"))


def _part_documents(spark, sf_dir) -> DataFrame:
    """Part names as records of seven fields, as documents."""
    p = _read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_brand").alias("b"), F.min("p_type").alias("t"))
    field_texts = [F.concat_ws(" ", "p_name", F.lit(word), "b", "t").alias(name) for name, word in _FIELD_WORDS]
    return chunking.documents_from_records(p.select(F.col("p_name").alias("name"), F.col("t").alias("category"), *field_texts))


@query(rf"""
WITH {_GROUND}, {_INTENTS[_INTENTS.index('rules(k'):]}, {_FIELDS},
p AS (SELECT p_name AS name, min(p_brand) AS b, min(p_type) AS t FROM part GROUP BY 1), fd(field, word) AS (SELECT * FROM {_values(_FIELD_WORDS)}),
ch AS (SELECT row_number() OVER (ORDER BY lower(trim(name)) || '::' || field) - 1 AS chunk_id, lower(trim(name)) AS drug, field, trim(name) || ' — ' || field || ': ' || name || ' ' || word || ' ' || b || ' ' || t AS text FROM p, fd),
tk AS (SELECT chunk_id, {_READABLE} AS ws FROM ch), post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM tk) GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM post GROUP BY 1), dl AS (SELECT chunk_id, len(ws) AS dl FROM tk), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
asked AS (SELECT qs.query_id, CASE WHEN any_value(term) FILTER (kind = 'alias') IS NULL THEN any_value(query) ELSE regexp_replace(any_value(query), '\b' || any_value(term) FILTER (kind = 'alias') || '\b', any_value(entity) FILTER (kind = 'alias'), 'gi') END AS text FROM qs JOIN gr USING (query_id) GROUP BY 1 HAVING count(entity) > 0),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_READABLE}) AS term FROM asked) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN dfreq USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), tot GROUP BY ALL),
ok AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT chunk_id, unnest({_ID.format('drug')}) AS token FROM ch) JOIN gr ON entity = token),
fwt AS (SELECT query_id, field, sum(confidence * weight) AS weight FROM dist JOIN fw USING (intent) GROUP BY ALL), best AS (SELECT *, max(weight) OVER (PARTITION BY query_id) AS top FROM fwt),
sc AS (SELECT bm.query_id, chunk_id, bm25 * CASE WHEN top > 0 THEN 1 + 0.2 * weight / top ELSE 1.0 END AS score FROM bm JOIN ok USING (query_id, chunk_id) JOIN ch USING (chunk_id) LEFT JOIN best ON best.query_id = bm.query_id AND best.field = ch.field WHERE bm25 >= 1.0),
rk AS (SELECT *, {_TOP.format('score', 'chunk_id')} AS rank FROM sc)
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM rk WHERE rank <= 5""")
def engine_retrieve(spark, sf_dir):
    """The engine over part names, by words alone: grounding, aliases, scores, restriction, boost by intent, floor and cut."""
    from ledgerwell.plans.engine import Engine

    results, _ = Engine(_part_documents(spark, sf_dir), _brands(spark)).retrieve(_inline(spark))
    return results.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


CHECKED = (("ring", "widget", "Major"), ("ring", "rod", "Minor"), ("widget", "rod", "Unknown"))


@query(f"""
WITH {_GROUND}, ip(a, b, level) AS (SELECT least(a, b), greatest(a, b), c FROM {_values(CHECKED)} AS t(a, b, c)),
asks AS (SELECT query_id FROM qs WHERE list_has_any(regexp_extract_all(lower(query), '[a-z]+'), {_sql_list(lists.INTERACTION_WORDS)}) OR {" OR ".join(f"contains(lower(query), '{x}')" for x in lists.INTERACTION_PHRASES)}),
mt AS (SELECT DISTINCT query_id, entity FROM gr JOIN asks USING (query_id) WHERE entity IS NOT NULL),
pr AS (SELECT x.query_id, level FROM mt x JOIN mt y ON x.query_id = y.query_id AND x.entity < y.entity LEFT JOIN ip ON a = x.entity AND b = y.entity),
ct AS (SELECT query_id, count(level) AS found, count(*) - count(level) AS clear, array_to_string(list_filter([{", ".join(f"CASE WHEN count(*) FILTER (level = '{n}') > 0 THEN count(*) FILTER (level = '{n}') || ' {n}' END" for n in lists.LEVEL_RANK)}], lambda x: x IS NOT NULL), ', ') AS counts FROM pr GROUP BY 1)
SELECT query_id, CASE WHEN found > 0 THEN found || ' documented interaction(s) (' || counts || ')' ELSE 'No documented interactions (' || clear || ' pair(s) checked)' END AS interaction FROM ct""")
def chat_prechecks(spark, sf_dir):
    """The chat flow: what stands before an answer to a question about an interaction of two known names or more."""
    from ledgerwell.plans.engine import Engine

    rows = spark.createDataFrame([("ord", *r) for r in CHECKED], "ord string, a_name string, b_name string, level string")
    known = grounding.vocabulary(_read(spark, sf_dir, "part"), "p_name").select(F.col("token").alias("name"), F.array("token").alias("tokens"))
    said, _ = Engine(_part_documents(spark, sf_dir), _brands(spark)).chat(_inline(spark), pairs.severest(rows), known)
    return said.where("interaction is not null").select("query_id", "interaction")


@query()
def grounded_answers(spark, sf_dir):
    """The engine over part names as records: grounding, hybrid scores with hashed vectors, personas, quoting, verification."""
    from ledgerwell.plans.engine import Engine

    engine = Engine(_part_documents(spark, sf_dir), _brands(spark), dense.hashing_encoder())
    out = engine.answer(_inline(spark), routing.PATIENT)
    return out.select("query_id", "status", "mode", "answer", "n_sources", F.array_join("dropped_fields", ",").alias("dropped"), "verification.grounded")
