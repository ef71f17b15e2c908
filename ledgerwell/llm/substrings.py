"""Repeated byte strings: every byte under a string of LENGTH bytes that also starts earlier is removed.

Ranking all positions at doubling offsets moves every position through a sort in each round, some 20 bytes a position and
round. So only chosen positions are ranked. Of a window of LENGTH bytes, the anchor is the place of its least hashed PREFIX
bytes (the leftmost of equals); equal windows have equal anchors, at the same place inside. Windows in a row that share
their anchor are one run, so a text has a run for about 35 bytes. The offsets then grow past the threshold:

1. PREFIX bytes at the anchors are ranked (by hash, sorted by Spark); anchors with a unique prefix are dropped.
2. Runs with the same prefix are ranked by all their bytes (LENGTH and more). Of equal runs, all but the earliest go whole.
3. Where one prefix still leads to different runs, the earliest run of each kind gives its single windows, which are ranked
   by their LENGTH bytes: all but the earliest of each go.

Task-side, equal runs of a chunk of text are settled before anything is shuffled, so that a passage in a third of all rows
reaches a sort once a chunk. A prefix with more than HOT kinds of runs spreads its windows by their own hash instead.

Null text is empty; text shorter than LENGTH is kept; a null id comes after all others. Repeated rows with the same id and text
count as one document, in which equal places don't remove each other; other rows that share an id, and all rows without one,
are documents of their own, in the order of a hash of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.bytewise import BYTE, INVERSE, chunks, mix, powers, prefix, stretch
from ledgerwell.llm.common import row_numbers, table, written

LENGTH, PREFIX = 100, 24
HOT = 50_000
#: Bytes of text that a task cuts at once; equal runs among them are settled before the shuffle.
CUT_BYTES = 1 << 22
LAST = 2**63 - 1
#: A removed stretch is one number: start * 2**SHIFT + length.
SHIFT = 10
_RUN = "key bigint, content bigint, did bigint, at bigint"
_STEP1 = "key bigint, did bigint, at bigint, open boolean"


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of `width` hashes from each place on, by doubling the width seen."""
    place = np.arange(len(hashes), dtype=np.int32)
    seen = 1
    while seen < width and len(hashes):
        step = min(seen, width - seen)
        left, right = hashes[:-step], hashes[step:]
        first = left <= right
        place = np.where(first, place[:-step], place[step:])
        hashes = np.where(first, left, right)
        seen += step
    return place


def runs(raw: np.ndarray, offsets: np.ndarray, length: int, prefix_length: int):
    """key, content, row, start and number of windows of each run of a chunk of rows."""
    n = len(raw)
    if n < length:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    sums = prefix(BYTE[raw])
    hashes = mix((sums[prefix_length:] - sums[:-prefix_length]) * powers(INVERSE, n)[: n - prefix_length + 1])
    anchor = anchors(hashes, length - prefix_length + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    place = np.flatnonzero(np.arange(len(anchor)) + length <= end)
    if not len(place):
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    cut = np.flatnonzero((np.diff(anchor[place]) != 0) | (np.diff(place) != 1)) + 1
    start, last = place[np.r_[0, cut]], place[np.r_[cut, len(place)] - 1]
    content = mix(stretch(sums, start, last + length) + (last - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    return hashes[anchor[start]], content, row, start - offsets[row], last - start + 1


def _cut_runs(length: int, prefix_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, raw, offsets in chunks(batch.column(1), CUT_BYTES):
                key, content, row, start, count = runs(raw, offsets, length, prefix_length)
                did = ids[a:b][row]
                order = np.lexsort((start, did, content, key))
                key, content, did, start, count = (x[order] for x in (key, content, did, start, count))
                later = np.zeros(len(key), bool)
                later[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
                if later.any():  # equal id and start: the same place of one document
                    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(key))))
                    later &= ~((did == did[first]) & (start == start[first]))
                # a settled run travels under a key of its own, as a negative place
                at = (start << SHIFT) | (count + length - 1)
                key = np.where(later, mix(did.view(np.uint64) + at.view(np.uint64)), key)
                at = np.where(later, -at, at)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(did), pa.array(at)], ["key", "content", "did", "at"])

    return run


def _rank_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, content, did, at: what goes whole, and (open) the earliest of each kind under a shared key."""
    key0 = content0 = did0 = at0 = None  # of the last row, and the first of its kind
    waiting: tuple | None = None  # the first kind of the key at hand, not known to be shared yet
    for batch in batches:
        key, content, did, at = (batch.column(c).to_numpy() for c in range(4))
        settled = at < 0
        out = [(key[settled], did[settled], -at[settled], np.zeros(int(settled.sum()), bool))]
        key, content, did, at = (x[~settled] for x in (key, content, did, at))
        if len(key):
            new_key = np.r_[key0 is None or key[0] != key0, key[1:] != key[:-1]]
            new_kind = new_key | np.r_[content0 is None or content[0] != content0, content[1:] != content[:-1]]
            first = np.maximum.accumulate(np.where(new_kind, np.arange(len(key)), -1))
            lead_did, lead_at = np.where(first >= 0, did[first], did0 if did0 is not None else 0), np.where(first >= 0, at[first], at0 if at0 is not None else 0)
            gone = ~new_kind & ((did != lead_did) | (at != lead_at))
            out.append((key[gone], did[gone], at[gone], np.zeros(int(gone.sum()), bool)))
            kinds = np.flatnonzero(new_kind)
            if len(kinds):
                shared = ~new_key[kinds]
                if waiting and shared[0]:
                    out.append(tuple(np.array([x]) for x in (*waiting, True)))
                follow = np.r_[shared[1:], False]
                open_ = kinds[shared | follow]
                out.append((key[open_], did[open_], at[open_], np.ones(len(open_), bool)))
                end = kinds[-1]
                waiting = (key[end], did[end], at[end]) if new_key[end] else None
            key0, content0, did0, at0 = key[-1], content[-1], lead_did[-1], lead_at[-1]
        cols = [np.concatenate([o[k] for o in out]) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "did", "at", "open"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (did, text, keys, ats): each open run with its bytes."""
    for batch in batches:
        key, did, at, data = [], [], [], []
        for d, text, keys, ats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = (text.as_py() or "").encode("utf-8")
            for k, a in zip(keys.as_py(), ats.as_py(), strict=True):
                s, n = a >> SHIFT, a & ((1 << SHIFT) - 1)
                if s + n <= len(raw):
                    key.append(k), did.append(d), at.append(a), data.append(raw[s : s + n])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(did, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary())], ["key", "did", "at", "data"])


def _windows(rows: pa.Table, length: int):
    """key, hash, did and start of every window of open runs."""
    key, did, at = (rows.column(c).to_numpy() for c in ("key", "did", "at"))
    data = rows.column("data").to_pylist()
    raw = np.frombuffer(b"".join(data), np.uint8)
    size = at & ((1 << SHIFT) - 1)
    begin = np.cumsum(np.r_[0, size])[:-1]
    count = size - length + 1
    row = np.repeat(np.arange(len(key)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, count])[:-1], count)
    place = begin[row] + inner
    return key[row], stretch(prefix(BYTE[raw]), place, place + length), did[row], (at >> SHIFT)[row] + inner


def _rank_windows(length: int):
    from ledgerwell.llm.neardup import _groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["key"]):
            key, hashed, did, start = _windows(rows, length)
            order = np.lexsort((start, did, hashed, key))
            key, hashed, did, start = (x[order] for x in (key, hashed, did, start))
            new = np.r_[True, (key[1:] != key[:-1]) | (hashed[1:] != hashed[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            gone = (did != did[first]) | (start != start[first])
            did, start = did[gone], start[gone]
            order = np.lexsort((start, did))
            did, start = did[order], start[order]
            if len(did):
                cut = np.flatnonzero((did[1:] != did[:-1]) | (start[1:] - start[:-1] > 1) | (np.arange(1, len(did)) % 512 == 0)) + 1
                a, b = np.r_[0, cut], np.r_[cut, len(did)] - 1
                did, start = did[a], (start[a] << SHIFT) | (start[b] - start[a] + length)
            yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(start)], ["did", "at"])

    return run


def _spread_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, hashed, did, start = _windows(pa.Table.from_batches([batch]), length)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(hashed.view(np.int64)), pa.array(did), pa.array((start << SHIFT) | length)], ["key", "hashed", "did", "at"])

    return run


def removed_mask(n: int, stretches: list[int]) -> np.ndarray:
    """Which of n bytes lie in a stretch."""
    edges = np.zeros(n + 1, np.int32)
    at = np.array(stretches, np.int64)
    start, end = np.minimum(at >> SHIFT, n), np.minimum((at >> SHIFT) + (at & ((1 << SHIFT) - 1)), n)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


_RESULT = pa.schema([("did", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _apply(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                at = at.as_py()
                gone = removed_mask(len(raw), at) if at else np.zeros(len(raw), bool)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).digest() if digest else left))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(_RESULT)[1:], strict=True))], schema=_RESULT)

    return run


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, did and text: did is the id where that names one text, and else a number for each document in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b"))
    if not hashed.where(f"a <> b or doc_id is null and n > 1 or doc_id = {LAST}").head(1):
        return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("did"), "text")
    rows = row_numbers(rows, "rows")
    first = rows.select("doc_id", F.xxhash64("text").alias("h"), "row").where("doc_id is not null").groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").drop("n")
    same = rows.withColumn("h", F.xxhash64("text")).join(first, ["doc_id", "h"], "left")
    return written(same.select("doc_id", F.coalesce("first", "row").alias("did"), "text"), "keyed")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, prefix_length: int = PREFIX, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that remain (digest: their SHA-256), for each row of docs."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _documents(docs)
    texts = own.select("did", "text")
    found = texts.mapInArrow(_cut_runs(length, prefix_length), _RUN).repartition(parts, "key").sortWithinPartitions("key", "content", "did", "at")
    ranked = written(found.mapInArrow(_rank_runs, _STEP1), "runs")
    opened = ranked.where("open").groupBy("did").agg(F.collect_list("key").alias("keys"), F.collect_list("at").alias("ats"))
    contexts = texts.join(opened, "did").select("did", "text", "keys", "ats").mapInArrow(_contexts, "key bigint, did bigint, at bigint, data binary")
    many = ranked.where("open").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key")
    gone = ranked.where("not open").select("did", "at")
    if many.head(1):
        contexts = written(contexts, "contexts")
        spread = contexts.join(many, "key", "left_semi").mapInArrow(_spread_windows(length), "key bigint, hashed bigint, did bigint, at bigint")
        least = spread.groupBy("key", "hashed").agg(F.min(F.struct("did", "at")).alias("first"))
        later = spread.join(least, ["key", "hashed"]).where("did <> first.did or at <> first.at").select("did", "at")
        gone = gone.unionByName(later)
        contexts = contexts.join(many, "key", "left_anti")
    dealt = contexts.repartition(parts, "key").sortWithinPartitions("key")
    gone = gone.unionByName(dealt.mapInArrow(_rank_windows(length), "did bigint, at bigint"))
    per_doc = gone.groupBy("did").agg(F.collect_list("at").alias("stretches"))
    out = own.join(per_doc, "did", "left").select("doc_id", "text", "stretches").mapInArrow(_apply(digest), "did bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("did", "doc_id")


def _positions(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode("utf-8"), np.uint8).astype(np.int64)
                n = max(0, len(raw) - first + 1)
                code = np.zeros(n, np.int64)
                for k in range(first):
                    code = (code << 8) | raw[k : k + n]
                yield pa.RecordBatch.from_arrays([pa.array([did] * n, pa.int64()), pa.array(np.arange(n)), pa.array(code), pa.array(np.zeros(n, np.int64))], ["did", "p", "r", "q"])

    return run


def doubled_ranks(docs: DataFrame, length: int = LENGTH, first: int = 7) -> DataFrame:
    """(did, p, first_did, first_p): every place whose `length` bytes recur, with the earliest place of the same bytes.

    Plain prefix doubling over all places, for small tables: Spark sorts the pairs of ranks at offsets 7, 14, 28 ... and
    names each pair by its earliest place; places with a unique pair are dropped; the last offset makes up the length.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), "text")
    ranks = texts.mapInArrow(_positions(first), "did bigint, p bigint, r bigint, q bigint")
    have = first
    while have < length:
        step = min(have, length - have)
        later = ranks.select("did", (F.col("p") - step).alias("p"), F.col("r").alias("r2"), F.col("q").alias("q2"))
        pairs = ranks.join(later, ["did", "p"])
        names = pairs.groupBy("r", "q", "r2", "q2").agg(F.min(F.struct("did", "p")).alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
        ranks = written(pairs.join(names, ["r", "q", "r2", "q2"]).select("did", "p", F.col("name.did").alias("r"), F.col("name.p").alias("q")), "doubling")
        have += step
    return ranks.select("did", "p", F.col("r").alias("first_did"), F.col("q").alias("first_p"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same rows by a dictionary of all strings, for tests."""
    seen: dict[bytes, int] = {}
    out = {}
    for k in sorted(range(len(docs)), key=lambda k: docs[k][0]):
        raw = (docs[k][1] or "").encode("utf-8")
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            else:
                seen[s] = 1
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (docs[k][0], len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return [out[k] for k in range(len(docs))]


#: The same by all positions: strings as hexadecimal text, equal ones told by their MD5.
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT k, 512 * j AS b, substr(h, 1024 * j + 1, {1022 + 2 * LENGTH}) AS h FROM (SELECT k, h, unnest(range(0, length(h) // 1024 + 1)) AS j FROM d)),
s AS (SELECT k, b + i AS i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS x FROM (SELECT k, b, h, unnest(range(0, length(h) // 2 - {LENGTH} + 1)) AS i FROM block)),
f AS (SELECT x, min((k::HUGEINT << 40) + i) AS first FROM s GROUP BY x HAVING count(*) > 1),
later AS (SELECT k, i FROM s JOIN f USING (x) WHERE (k::HUGEINT << 40) + i > first),
isle AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM later)),
gone AS (SELECT k, min(i) AS a, max(i) + {LENGTH} AS b FROM isle GROUP BY k, g),
cut AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM gone),
kept AS (SELECT k, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a) AS n_removed, count(*) AS n_spans FROM cut JOIN d USING (k) GROUP BY k)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
