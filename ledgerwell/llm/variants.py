"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped without forming pairs.

1. Letter runs of all texts are counted. The words with enough occurrences, sorted by falling count and then by the word, are
   numbered by range: of two words the one with the smaller rank is the better form, so ranks stand for words from here on.
2. A word of n letters joins n wildcard groups, one for each (position, prefix, suffix) without its letter there. Words that share
   a group differ in that letter alone. A group's size and its two best ranks tell each member how many others it has, and
   the best of them.
3. Each different word that is left when a letter goes joins the group of that word. If the vocabulary holds it, the two are one
   insertion apart: the longer learns of the shorter, and the shorter how many longer ones there are, and the best of them.
4. What a word has learnt in its groups is summed by rank. A form at least twice as frequent is followed to the last by doubling
   steps; counts double along such a chain, so that it has at most 63 words.

A group holds one word for each letter of the alphabet (2, and n + 1 places of it in 3), so no group grows with the corpus. Group
keys are 128 bits: sums of random values for each (place, letter), from which those of all positions follow in one pass, so
that a word of n letters costs n and not its square; two keys that differ agree with a chance of 2**-128.

Null texts have no words; a null doc_id counts as an empty string in the damage; a text is taken whole; a long run is a word
like any other, and takes some 100 bytes a letter of a task's memory; repeated rows count again; ties go to the word that is
first in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.bytewise import mix
from ledgerwell.llm.common import CRC32_SQL, spread_join, table, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: Letters of words whose keys are made at once, and rows of a batch of keys.
LETTERS, ROWS = 1 << 19, 1 << 17
WORD, SHORTER, WILD = 0, 1, 2
#: Multipliers and offsets of the two halves of a key.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SEED = np.array([0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("rank", pa.int64()), ("kind", pa.int32())])


def runs(docs: DataFrame, every: int = 0) -> DataFrame:
    """A row for each letter run, A-Z lower-cased. every: runs whose hash with the id it divides lose one letter (test damage)."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    found = found.select("doc_id", lower.alias("word"))
    if every:
        found = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        without = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        found = found.select(F.when(F.col("h") % every == 0, without).otherwise(F.col("word")).alias("word"))
    return found.select("word")


def vocabulary(words: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """word, n and rank of the words with enough letters and occurrences, written; rank rises with falling n, then with the word."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = [F.col("n").desc(), F.col("word")]
    return written(counted.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "vocabulary")


def group_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group that a word joins: its key (two columns), the word's number, and the kind of membership."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    starts, owner = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    place = (np.arange(len(letters)) - starts[owner]).astype(np.uint64)
    first = np.ones(len(letters), bool)  # of equal neighbours only the first is taken out
    first[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    columns = []
    for factor, seed in zip(_PLACE, _SEED, strict=True):
        here = mix(place * factor + letters + seed)
        before = mix((place - np.uint64(1)) * factor + letters + seed)  # the letter one place to the left
        sums, moved = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (here, before))
        whole = sums[ends] - sums[starts]
        at = np.arange(len(letters))
        shorter = sums[at] - sums[starts[owner]] + moved[ends[owner]] - moved[at + 1]
        wild = whole[owner] - here + mix(place * factor + ~seed)
        columns.append(np.concatenate([whole, shorter[first], wild]))
    number = np.concatenate([np.arange(len(words)), owner[first], owner])
    kind = np.repeat(np.array([WORD, SHORTER, WILD], np.int32), [len(words), first.sum(), len(letters)])
    return np.stack(columns, 1), number, kind


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, ranks = b.column("word").to_pylist(), b.column("rank").to_numpy()
        cuts, size = [0], 0
        for k, w in enumerate(words):
            if size and size + len(w) > LETTERS:
                cuts.append(k)
                size = 0
            size += len(w)
        for a, z in zip(cuts, [*cuts[1:], len(words)], strict=True):
            if a < z:
                keys, number, kind = group_keys(words[a:z])
                for k in range(0, len(kind), ROWS):
                    part = slice(k, k + ROWS)
                    own = keys[part].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(ranks[a + number[part]]), pa.array(kind[part])], schema=KEYS)


def neighbours(words: DataFrame) -> DataFrame:
    """rank, n_near (words one edit apart) and best (the least rank of them) of the words (word, rank) that have any."""
    keyed = words.select("word", "rank").mapInArrow(_keyed, "k1 bigint, k2 bigint, rank bigint, kind int")
    group = Window.partitionBy("k1", "k2")
    member = F.col("kind") != WORD
    seen = keyed.select(
        "rank", "kind",
        F.count(F.when(member, 1)).over(group).alias("size"),
        F.min(F.when(member, F.col("rank"))).over(group).alias("top"),
        F.lead("rank").over(group.orderBy("rank")).alias("next"),
        F.max(F.when(~member, F.col("rank"))).over(group).alias("whole"),
    )
    kind = F.col("kind")
    near = F.when(kind == WILD, F.col("size") - 1).when(kind == WORD, F.col("size")).otherwise(F.when(F.col("whole").isNull(), 0).otherwise(1))
    best = F.when(kind == SHORTER, F.col("whole")).when((kind == WILD) & (F.col("rank") == F.col("top")), F.col("next")).otherwise(F.col("top"))
    return seen.select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """rank and the last form of each word (rank, form) that has one; each round doubles the steps taken."""
    ends = written(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        jump = ends.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        moved = written(spread_join(ends, jump, "root", "rank", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ends = moved.select("rank", "root")
        if moved.where("moved").isEmpty():
            return ends


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a vocabulary (word, n, rank)."""
    own = words.alias("w").join(neighbours(words).alias("x"), "rank", "left")
    better = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = own.join(better, "best", "left")
    good = F.col("form_n") >= times * F.col("n")
    linked = written(linked.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(good, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")
    last = roots(linked.where("best is not null").select("rank", F.col("best").alias("form")))
    named = last.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return linked.join(named, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(runs(table(spark, sf_dir, "documents"), every=97)))


_BYTES = "flatten(list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))"
OP12_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT k, count(*) AS n FROM (
        SELECT coalesce(doc_id::VARCHAR, '') || ':' || translate(unnest(regexp_extract_all(text, '{RUN}')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM documents)
    GROUP BY k
), hashed AS (
    SELECT n, substr(k, instr(k, ':') + 1) AS run, {CRC32_SQL.format(bytes=_BYTES)} AS h FROM runs
), vocabulary AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), letters AS (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), wild AS (
    SELECT word, n, i, left(word, i - 1) AS p, substr(word, i + 1) AS s FROM letters
), shorter AS (
    SELECT DISTINCT w.word AS long, w.n AS n_long, v.word AS short, v.n AS n_short FROM wild w JOIN vocabulary v ON v.word = w.p || w.s
), near AS (
    SELECT a.word, b.word AS other, b.n AS n_other FROM wild a JOIN wild b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
    UNION ALL SELECT long, short, n_short FROM shorter UNION ALL SELECT short, long, n_long FROM shorter
), best AS (
    SELECT word, count(*) AS n_near, min({{'n': -n_other, 'word': other}}) AS b FROM near GROUP BY word
), forms AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * v.n THEN b.word END AS form, CASE WHEN -b.n >= 2 * v.n THEN -b.n END AS form_n FROM vocabulary v LEFT JOIN best ON best.word = v.word
), chain AS (
    SELECT word, word AS tip, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL
)
SELECT f.word, form, r.root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(tip, k) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""
