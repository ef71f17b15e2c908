"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each task cuts its documents into shards, turns words into benchmark word numbers (0: in no item) and sorts the suffixes of
a shard that could match, that is, those whose first words are all benchmark words. Every different window that starts a suffix
of a benchmark item is then binary-searched in that array: the range of suffixes that share it gives all its places. From
there the benchmark's own suffix array is narrowed word by word, which gives the longest verbatim match. Documents with any
hit are removed, or reported word by word.

The work grows with the places found, not with the items that share a window: windows are searched once, and windows with the
same items share one list of them. The benchmark is taken in blocks of at most BLOCK_WORDS words, longer items in pieces. A
benchmark of one block goes to the tasks with their code, in one pass without a shuffle. A larger one takes one pass for each
block over the numbered and written documents; driver and tasks hold one block at a time, and the hits are joined back by row.

Null texts have no words and no hits; null items and items without words match nothing; an item with a null id marks hits but
isn't named; repeated items count once by name; repeated rows are judged one by one; a text is worked on whole, however long,
alone in its shard beyond SHARD_WORDS; an empty table or benchmark leaves every row clean; of equally long matches the first
place is told; all columns of docs pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwell.llm.common import columns, row_numbers, table, written

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 2_000_000
#: Item names in one batch of reports.
BATCH_NAMES = 100_000
#: Bytes of words stay, A-Z in lower case; all else separates.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split() if text else []


def packed(ids: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """At each place, the next per_key ids in one integer, 0 beyond the end."""
    out = np.zeros(len(ids), np.int64)
    for k in range(per_key):
        out <<= bits
        out[: max(0, len(ids) - k)] |= ids[k:]
    return out


def bisect_rows(columns: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Where each wanted tuple belongs in sorted tuples, all searched at once."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(columns[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(columns[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for have, want in zip(columns, wanted, strict=True):
            less |= same & (have[mid] < want)
            same &= have[mid] == want
        below = less | same if right else less
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The places of words (ids above 0) in the order of their suffixes, which end at the next 0, by prefix doubling."""
    ends = np.flatnonzero(ids == 0)
    rank = np.r_[ids + len(ends), 0]
    rank[ends] = np.arange(len(ends))  # each end is of its own, so that no comparison passes it
    longest = int(np.diff(np.r_[-1, ends]).max(initial=1))
    step = 1
    order = np.argsort(rank[:-1], kind="stable")
    while step < longest:
        after = rank[np.minimum(np.arange(len(ids)) + step, len(ids))]
        order = np.lexsort((after, rank[:-1]))
        a, b = rank[:-1][order], after[order]
        named = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank[order] = named
        step *= 2
    return order[ids[order] > 0]


class Items:
    """A block of benchmark items, given as names and words, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        ids, item, end, first = [], [], [], []
        for name, ws in items:
            first.append(len(ids))
            end += [len(ids) + len(ws)] * (len(ws) + 1)
            item += [number.get(name, -1)] * (len(ws) + 1)
            ids += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws] + [0]
        self.ids, end, item = np.array([*ids, 0], np.int64), np.array([*end, len(ids)], np.int64), np.array([*item, -1], np.int64)
        self.bits = max(1, len(self.vocab).bit_length())
        self.per_key = min(window, 62 // self.bits)
        self.n_keys = -(-window // self.per_key)
        left = end - np.arange(len(end))
        chosen = (left >= window) & (self.ids > 0)
        chosen[first] = self.ids[first] > 0
        at = np.flatnonzero(chosen)
        need = np.minimum(left[at], window)
        self.least = int(need.min(initial=window))
        self._distinct(at, need, item[at])
        self._sorted: tuple | None = None

    def _keys(self, at: np.ndarray, need: np.ndarray, fill: int) -> list[np.ndarray]:
        """The packed words of windows, places beyond a window filled."""
        out = []
        for k in range(self.n_keys):
            key = np.zeros(len(at), np.int64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << self.bits) | np.where(j < need, self.ids[np.minimum(at + j, len(self.ids) - 1)], fill)
            out.append(key)
        return out

    def _distinct(self, at: np.ndarray, need: np.ndarray, item: np.ndarray) -> None:
        """The different windows, their bounds among packed suffixes, and the set of items of each."""
        low = self._keys(at, need, 0)
        order = np.lexsort((item, need, *low[::-1]))
        same = np.ones(max(0, len(at) - 1), bool)
        for column in (*low, need):
            same &= column[order][1:] == column[order][:-1]
        new = np.r_[True, ~same] if len(at) else np.zeros(0, bool)
        window, chosen = np.cumsum(new) - 1, order[new]
        self.at, self.need = at[chosen], need[chosen]
        self.low, self.high = [c[chosen] for c in low], self._keys(self.at, self.need, (1 << self.bits) - 1)
        item = item[order]
        named = (item >= 0) & np.r_[True, ~same | (item[1:] != item[:-1])][: len(item)]
        window, item = window[named], item[named]
        bound = np.searchsorted(window, np.arange(len(self.at) + 1))
        self.item_set, self.sets, known = np.zeros(len(self.at), np.int64), [], {}
        for k, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
            own = item[a:b].tobytes()
            if own not in known:
                known[own] = len(self.sets)
                self.sets.append(item[a:b])
            self.item_set[k] = known[own]

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's suffixes that start with a whole window, sorted, and where those of each window begin and end."""
        if self._sorted is None:
            order = suffix_order(self.ids[:-1])
            whole = np.flatnonzero(self.need == self.window)
            # a suffix belongs to the last window that is not greater than it, if that is its beginning
            columns = self._keys(order, np.full(len(order), self.window), 0)
            bounds = [bisect_rows(columns, [c[whole] for c in side], right) for side, right in ((self.low, False), (self.high, True))]
            begin, end = np.zeros((2, len(self.at)), np.int64)
            begin[whole], end[whole] = bounds
            self._sorted = (order, begin, end)
        return self._sorted


def search(block: Items, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (shard place, number of window) of a shard's ids, which are 0 between documents."""
    none = np.zeros(0, np.int64)
    known = np.cumsum(np.r_[0, ids > 0])
    m = block.least
    if len(ids) < m or not len(block.at):
        return none, none
    place = np.flatnonzero(known[m:] - known[:-m] == m)
    if not len(place):
        return none, none
    key = np.r_[packed(ids, block.bits, block.per_key), np.zeros(block.n_keys * block.per_key, np.int64)]
    columns = [key[place + k * block.per_key] for k in range(block.n_keys)]
    order = np.lexsort(columns[::-1])
    suffixes, columns = place[order], [c[order] for c in columns]
    lo, hi = bisect_rows(columns, block.low, False), bisect_rows(columns, block.high, True)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return suffixes[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())], which


def extended(block: Items, ids: np.ndarray, place: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The length of the longest match with any item at places that hold whole windows."""
    order, begin, end = block.suffixes()
    lo, hi = begin[which], end[which]
    length = np.full(len(place), block.window)
    padded = np.r_[ids, 0]
    open_ = np.flatnonzero(hi > lo)
    while len(open_):
        word = padded[np.minimum(place[open_] + length[open_], len(ids))]
        bounds = []
        for right in (False, True):
            a, b = lo[open_].copy(), hi[open_].copy()
            while (busy := a < b).any():
                mid = (a + b) >> 1
                have = block.ids[np.minimum(order[np.minimum(mid, len(order) - 1)] + length[open_], len(block.ids) - 1)]
                below = have <= word if right else have < word
                a, b = np.where(busy & below, mid + 1, a), np.where(busy & ~below, mid, b)
            bounds.append(a)
        more = (bounds[1] > bounds[0]) & (word > 0)
        open_ = open_[more]
        lo[open_], hi[open_] = bounds[0][more], bounds[1][more]
        length[open_] += 1
    return length


def longest_matches(block: Items, ids: np.ndarray, place: np.ndarray, which: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The length and shard place of the longest match of each document; 0 and -1 without one.

    Of a run of neighbouring hits, a later place can only beat the best so far while the rest of the run is long enough.
    """
    best, best_at = np.zeros(n, np.int64), np.full(n, -1)

    def settle(at: np.ndarray, length: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((at, -length, doc))
        at, length, doc = at[order], length[order], doc[order]
        first = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
        at, length, doc = at[first], length[first], doc[first]
        better = (length > best[doc]) | (length == best[doc]) & (at < best_at[doc])
        best[doc[better]], best_at[doc[better]] = length[better], at[better]

    whole = block.need[which] == block.window
    settle(place[~whole], block.need[which[~whole]], owner[~whole])
    order = np.argsort(place[whole])
    at, window, doc = place[whole][order], which[whole][order], owner[whole][order]
    if len(at):
        run = np.cumsum(np.r_[0, np.diff(at) != 1])
        last = at[np.searchsorted(run, run, "right") - 1]
        k = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        while len(k):
            settle(at[k], extended(block, ids, at[k], window[k]), doc[k])
            k = k[at[k] < last[k]] + 1
            most = last[k] - at[k] + block.window
            k = k[(most > best[doc[k]]) | (most == best[doc[k]]) & (at[k] < best_at[doc[k]])]
    return best, best_at


_FIELDS = [("n_words", T.LongType(), pa.int64()), ("spans", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("n_items", T.LongType(), pa.int64()), ("items_sha256", T.StringType(), pa.string()), ("items", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("longest", T.IntegerType(), pa.int32()), ("longest_at", T.IntegerType(), pa.int32())]
REPORT = T.StructType([T.StructField(name, kind) for name, kind, _ in _FIELDS])
_ARROW = pa.struct([(name, kind) for name, _, kind in _FIELDS])


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _reports(block: Items, docs: list[np.ndarray], named: bool, known: dict) -> Iterator[dict]:
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    ids = np.zeros(starts[-1], np.int64)
    for s, d in zip(starts, docs, strict=False):
        ids[s : s + len(d)] = d
    place, which = search(block, ids)
    owner = np.searchsorted(starts, place, "right") - 1
    edges = np.bincount(place, minlength=len(ids) + 1) - np.bincount(place + block.need[which], minlength=len(ids) + 1)
    hit = np.r_[False, np.cumsum(edges[:-1]) > 0, False]
    begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    spans = np.searchsorted(begin, starts)
    best, best_at = longest_matches(block, ids, place, which, owner, len(docs))
    pairs = np.unique(owner * (len(block.sets) + 1) + block.item_set[which])
    of, item_set = pairs // (len(block.sets) + 1), pairs % (len(block.sets) + 1)
    bound = np.searchsorted(of, np.arange(len(docs) + 1))
    for k, d in enumerate(docs):
        a, b = spans[k], spans[k + 1]
        own = tuple(item_set[bound[k] : bound[k + 1]].tolist())
        if own not in known:
            if len(known) > 10_000:
                known.clear()
            names = [block.names[i] for i in np.unique(np.concatenate([block.sets[x] for x in own]))] if own else []
            known[own] = (len(names), digest(names), names if named else None)
        n_items, sha, names = known[own]
        flat = (np.stack([begin[a:b], end[a:b]], 1) - starts[k]).ravel().tolist()
        yield {"n_words": len(d), "spans": flat, "n_items": n_items, "items_sha256": sha, "items": names, "longest": int(best[k]), "longest_at": int(best_at[k] - starts[k]) if best[k] else None}


def _pass(block: Items, named: bool, only_hits: bool):
    block.suffixes()  # sorted once, here, and sent with the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, known = block.vocab.get, {}
        for batch in batches:
            row, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(row):
                docs, total, start = [], 0, at
                while at < len(row) and (total < SHARD_WORDS or at == start):
                    ws = split_words(texts[at].as_py())
                    docs.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
                    total += len(ws)
                    at += 1
                held, places, size = [], [], 0
                for k, report in enumerate(_reports(block, docs, named, known), start):
                    if report["spans"] or not only_hits:
                        held.append(report), places.append(k)
                        size += len(report["items"] or ())
                    if held and size > BATCH_NAMES:
                        yield pa.RecordBatch.from_arrays([row.take(pa.array(places)), pa.array(held, _ARROW)], ["row", "report"])
                        held, places, size = [], [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(places)), pa.array(held, _ARROW)], ["row", "report"])

    return run


def blocks(bench: DataFrame, window: int, most: int) -> Iterator[Items]:
    """The items in blocks of about `most` words, read one partition at a time; longer items in pieces that share no window."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for name, text in bench.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        ws = split_words(text)
        for at in range(0, max(1, len(ws) - window + 1), most) if ws else ():
            piece = ws[at : at + most + window - 1]
            if held and size + len(piece) > most:
                yield Items(held, window)
                held, size = [], 0
            held.append((name, piece))
            size += len(piece)
    yield Items(held, window)


def _merged(named: bool):
    """Of rows (row, reports of all blocks): one report for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, reports in enumerate(batch.column(1)):
                reports = reports.as_py()
                out: list[int] = []
                for s, e in sorted((s, e) for r in reports for s, e in zip(r["spans"][::2], r["spans"][1::2], strict=True)):
                    if out and s <= out[-1]:
                        out[-1] = max(out[-1], e)
                    else:
                        out += [s, e]
                names = sorted({x for r in reports for x in r["items"]})
                best = max(reports, key=lambda r: (r["longest"], -r["longest_at"]))
                one = best | {"spans": out, "n_items": len(names), "items_sha256": digest(names), "items": names if named else None}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([one], _ARROW)], ["row", "report"])

    return run


def overlaps(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, named: bool = False) -> DataFrame:
    """row (all columns of docs) and report: n_words, spans of hit words (start, end, start, end ...), the number of items,
    the digest of their names, the names if asked for, and length and place of the longest match."""
    found = blocks(bench, window, block_words)
    block, following = next(found), next(found, None)
    if following is None:
        rows = docs.select(F.struct("*").alias("row"), "text")
        schema = rows.select("row", F.lit(None).cast(REPORT).alias("report")).schema
        return rows.mapInArrow(_pass(block, named, False), schema)
    rows = row_numbers(docs.select(F.struct(*columns(docs)).alias("own"), "doc_id", "text"), "decontam-rows")
    hits = None
    while block is not None:
        schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("report", REPORT)])
        one = written(rows.select("row", "text").mapInArrow(_pass(block, True, True), schema), "decontam-hits")
        hits = one if hits is None else hits.unionByName(one)
        block, following = following, next(found, None)
    merged = hits.groupBy("row").agg(F.collect_list("report").alias("reports")).mapInArrow(_merged(named), schema)
    count = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    clean = F.struct(count.alias("n_words"), F.array().cast("array<int>").alias("spans"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.when(F.lit(named), F.array().cast("array<string>")).alias("items"), F.lit(0).alias("longest"), F.lit(None).cast("int").alias("longest_at"))
    return rows.join(merged, "row", "left").select(F.col("own").alias("row"), F.coalesce("report", clean).alias("report"))


def n_hit(report: Column) -> Column:
    spans = report["spans"]
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark."""
    return overlaps(docs, bench, window).where(F.size("report.spans") == 0).select("row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and length and place (in words) of each document's longest match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark")).select("row.doc_id", "report")
    report = F.col("report")
    return found.select(
        "doc_id",
        "report.n_words",
        n_hit(report).alias("n_hit"),
        "report.n_items",
        "report.items_sha256",
        (F.size("report.spans") > 0).alias("contaminated"),
        "report.longest",
        "report.longest_at",
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same rows by comparing every window with every place, for tests."""
    out = []
    for doc_id, text in docs:
        ws = split_words(text)
        hit, names, best = set(), set(), (0, 0)
        for name, item in items:
            iw = split_words(item)
            for k in range(max(1, len(iw) - window + 1)) if iw else ():
                win = iw[k : k + window]
                for p in range(len(ws) - len(win) + 1):
                    if ws[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names |= {str(name)} - {"None"}
                        n = len(win)
                        while p + n < len(ws) and k + n < len(iw) and ws[p + n] == iw[k + n]:
                            n += 1
                        best = max(best, (n, -p))
        out.append((doc_id, len(ws), len(hit), len(names), digest(sorted(names)), bool(hit), best[0], -best[1] if best[0] else None))
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LIST = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_LIST} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, {_LIST} AS ws FROM benchmark),
win AS (
  SELECT r, item_id, j, len(ws[j:j + {WINDOW - 1}]) AS n, array_to_string(ws[j:j + {WINDOW - 1}], ' ') AS w
  FROM (SELECT r, item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS j FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hits AS (SELECT doc_id, r, item_id, i, j, n FROM dw JOIN win USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
), runs AS (
  SELECT doc_id, min(i) AS i, count(*) + n - 1 AS n
  FROM (SELECT doc_id, r, i, j, n, i - row_number() OVER (PARTITION BY doc_id, r, n, i - j ORDER BY i) AS island FROM hits)
  GROUP BY doc_id, r, n, i - j, island
), best AS (SELECT doc_id, max(n) AS longest, min(i) FILTER (n = top) - 1 AS longest_at
  FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM runs) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated,
  coalesce(longest, 0)::INT AS longest, longest_at::INT AS longest_at
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""
