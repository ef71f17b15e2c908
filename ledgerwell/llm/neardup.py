"""MinHash near-duplicates with b-bit signatures.

1. Each text becomes its set of hashed word shingles; texts with equal sets are one class, led by the smallest id.
2. Of every class, ROWS * BANDS minima are taken. Groups of ROWS full minima make the band keys; of each minimum only the
   low BITS bits are kept, packed in the signature.
3. Classes that share a band key are compared by counting equal b-bit fields. The share expected from chance, 2**-BITS, is
   taken off; a pair stays when its corrected similarity could come from the threshold, with an error below 1e-7. Only a
   spanning forest leaves a task.
4. Inside each component of these candidates the full sets are compared, and the exact links of a spanning forest make the
   final components.

Groups with many members are cut in blocks. Each block meets itself and the first block; then whoever is still outside the
group's largest component meets all others. No link between components is lost, and what hangs together isn't compared again.

A pair at the threshold of 0.8 misses all bands with a chance of 3e-8. Null and blank texts have no shingles and link with
nothing; rows with a null id link with nothing; rows that share an id are one document; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.bytewise import mix, shingle_sets
from ledgerwell.llm.common import spread_join, table, written
from ledgerwell.llm.components import components

ROWS, BANDS, BITS = 3, 24, 4
#: Members of a block in the candidate and in the exact step.
BLOCK, TEXT_BLOCK = 1500, 256
_rng = np.random.default_rng(911)
_XOR = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: float, k: int = ROWS * BANDS, bits: int = BITS, error: float = 1e-7) -> int:
    """The fewest equal fields that a pair at the threshold shows, but for the error."""
    p = threshold + (1 - threshold) / 2**bits
    tail = 0.0
    for m in range(k + 1):
        tail += comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > error:
            return m
    return k


def corrected_similarity(matches: int, k: int = ROWS * BANDS, bits: int = BITS) -> float:
    """The similarity that a share of equal fields estimates, less the collisions of cut minima."""
    chance = 2.0**-bits
    return (matches / k - chance) / (1 - chance)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, in parts that bound memory."""
    best = np.full(len(_ODD), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(best, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(1), out=best)
    return best


def pack(low: np.ndarray) -> bytes:
    """Fields of BITS bits, two to a byte."""
    return (low[0::2] | (low[1::2] << 4)).astype(np.uint8).tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])
SIGNED = "doc_id bigint, n_shingles bigint, digest binary, sig binary, keys array<bigint>"


def _sign(shingle: int):
    import hashlib

    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                if not len(s):
                    digest.append(None), sig.append(None), keys.append([])
                    continue
                low = minima(s)
                bands = low.reshape(BANDS, ROWS)
                key = mix(bands[:, 0] + salt)
                for r in range(1, ROWS):
                    key = mix(key + bands[:, r] * np.uint64(2 * r + 1))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(pack((low >> np.uint64(20)) & np.uint64(2**BITS - 1)))
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 62) -> Iterator[pa.Table]:
    """The rows of a sorted partition in whole groups: tables in which no group is cut, each with some groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            changes[1:] |= v[1:] != v[:-1]
            if held:
                changes[0] |= held[-1].column(k)[-1].as_py() != v[0]
        cut = np.flatnonzero(changes)
        if len(cut):
            last = int(cut[-1])
            head = [*held, batch.slice(0, last)]
            head = [b for b in head if b.num_rows]
            if head:
                yield pa.Table.from_batches(head)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table_: pa.Table, keys: list[str]) -> np.ndarray:
    changes = np.zeros(table_.num_rows + 1, bool)
    changes[[0, -1]] = True
    for k in keys:
        v = table_.column(k).to_numpy()
        changes[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(changes)


def forest(linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest; linked(i) tells all neighbours of i as a boolean array."""
    edges, n = [], None
    seen = None
    start = 0
    while True:
        if seen is None:
            row = linked(0)
            n = len(row)
            seen = np.zeros(n, bool)
        left = np.flatnonzero(~seen[start:])
        if not len(left):
            return edges
        start += int(left[0])
        seen[start] = True
        queue = [start]
        while queue:
            i = queue.pop()
            if seen.all():
                return edges
            new = np.flatnonzero(linked(i) & ~seen)
            seen[new] = True
            edges += [(i, int(j)) for j in new]
            queue += new.tolist()


_POP = np.array([bin(x & 15).count("1") == 0 for x in range(256)], np.uint8) + np.array([bin(x >> 4).count("1") == 0 for x in range(256)], np.uint8)
_KEYS = ["key", "i", "j"]


def _candidates(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, _KEYS):
            ids = rows.column("rep").to_numpy()
            side = rows.column("side").to_numpy()
            cross = (rows.column("i").to_numpy() != rows.column("j").to_numpy())
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            cut = _bounds(rows, _KEYS)
            size = np.diff(cut)
            a, b = [], []
            two = cut[:-1][size == 2]
            if len(two):
                ok = (_POP[sig[two] ^ sig[two + 1]].sum(1, dtype=np.int32) >= least) & ~(cross[two] & (side[two] == side[two + 1]))
                a.append(ids[two[ok]]), b.append(ids[two[ok] + 1])
            for s, e in zip(cut[:-1][size > 2], cut[1:][size > 2], strict=True):
                part, sides, apart = sig[s:e], side[s:e], bool(cross[s])
                linked = lambda i, part=part, sides=sides, apart=apart: (_POP[part ^ part[i]].sum(1, dtype=np.int32) >= least) & ((sides != sides[i]) if apart else True)
                pairs = np.array(forest(linked), np.int64).reshape(-1, 2) + s
                a.append(ids[pairs[:, 0]]), b.append(ids[pairs[:, 1]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _exact(shingle: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["root", "i", "j"]
        for rows in _groups(batches, keys):
            ids, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            cross = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            cut = _bounds(rows, keys)
            text = rows.column("text")
            a, b = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                sets = list(shingle_sets(text.slice(s, e - s).combine_chunks(), shingle))
                size = np.array([len(x) for x in sets], np.int64)
                owner = np.repeat(np.arange(len(sets)), size)
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                names, first = np.unique(flat[order], return_index=True)
                by_name, bound = owner[order], np.append(first, len(flat))
                sides, apart = side[s:e], bool(cross[s])

                def linked(i, sets=sets, size=size, names=names, by_name=by_name, bound=bound, sides=sides, apart=apart):
                    at = np.searchsorted(names, sets[i])
                    lo, n = bound[at], bound[at + 1] - bound[at]
                    places = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    both = np.bincount(by_name[places], minlength=len(sets))
                    ok = (den * both >= num * (size + size[i] - both)) & (both > 0)
                    ok[i] = False
                    return ok & (sides != sides[i]) if apart else ok

                pairs = np.array(forest(linked), np.int64).reshape(-1, 2) + s
                a.append(ids[pairs[:, 0]]), b.append(ids[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _own_block(node: str, n: Column, most: int) -> Column:
    return F.pmod(F.xxhash64(node), F.ceil(n / most).cast("int")).cast("int")


def _first_pairs(rows: DataFrame, node: str, most: int) -> DataFrame:
    """Deals a group of n members to tasks: each block with itself and with block 0. Adds side and the pair i <= j."""
    rows = rows.withColumn("side", _own_block(node, F.col("n"), most))
    every = F.when(F.col("n") <= most, F.array(F.lit(0))).when(F.col("side") > 0, F.array(F.lit(0), F.col("side"))).otherwise(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))
    rows = rows.withColumn("other", F.explode(every))
    return rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))


def _later_pairs(rows: DataFrame, key: str, node: str, linked: DataFrame, most: int) -> DataFrame | None:
    """For groups of several blocks: members outside the group's largest component so far, in blocks, with all members.

    Members inside it are connected, so no pair of those is needed. None when nobody is left outside.
    """
    large = rows.where(F.col("n") > most).join(linked.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col(node) == F.col("_n"), "left")
    large = large.withColumn("_r", F.coalesce("_r", node)).drop("_n")
    main = large.groupBy(key, "_r").agg(F.count("*").alias("c")).groupBy(key).agg(F.max(F.struct("c", "_r"))["_r"].alias("_main"))
    large = spread_join(large, main, key, node)
    outside = large.where("_r <> _main")
    left = outside.groupBy(key).agg(F.count("*").alias("_out"))
    if left.isEmpty():
        return None
    large = spread_join(large, left, key, node)
    blocks = F.ceil(F.col("_out") / most).cast("int")
    asked = large.where("_r <> _main").withColumn("i", -1 - F.pmod(F.xxhash64(node), blocks)).withColumn("side", F.lit(0)).withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1)))
    every = large.withColumn("j", _own_block(node, F.col("n"), most)).withColumn("side", F.lit(1)).withColumn("i", F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: -1 - b)))
    cols = [c for c in rows.columns] + ["i", "j", "side"]
    narrow = lambda df: df.select(*(F.col(c).cast("int").alias(c) if c in ("i", "j", "side") else c for c in cols))
    return narrow(asked).unionByName(narrow(every))


def _linked(rows: DataFrame, key: str, node: str, most: int, compare, tag: str) -> DataFrame:
    """(node, root): components of the links that compare finds inside the groups of rows (key, n, node, ...).

    Two rounds: blocks against themselves and the first block, then whoever is outside the largest component against all.
    So a group whose members mostly hang together costs its size, not its square, and no link between components is lost.
    """
    fields = [c for c in rows.columns if c != "n"]
    keys = [key, "i", "j"]

    def found(dealt: DataFrame) -> DataFrame:
        return _dealt(dealt.select(*fields, "i", "j", "side"), keys).mapInArrow(compare, "a bigint, b bigint").where("a <> b").distinct()

    links = written(found(_first_pairs(rows, node, most)), f"{tag}-links")
    first = written(components(links), f"{tag}-first")
    later = _later_pairs(rows, key, node, first, most)
    return first if later is None else components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found(later)))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text): linked where den * intersection >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_sign(shingle), SIGNED), "signed")
    usable = signed.where("digest is not null and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "keys")).alias("m"), F.count("*").alias("n"))
    classes = written(classes.select("digest", F.col("m.doc_id").alias("rep"), F.when(F.col("n") == 1, F.col("m.doc_id")).alias("lone"), "m.sig", "m.keys"), "classes")
    banded = classes.select("rep", "sig", F.explode("keys").alias("key"))
    shared = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(banded.join(shared, "key").select("key", "n", "rep", "sig"), "shared")
    coarse = written(_linked(rows, "key", "rep", BLOCK, _candidates(least_matches(num / den)), "coarse"), "coarse")
    sizes = coarse.groupBy("root").agg(F.count("*").alias("n"))
    members = docs.join(spread_join(coarse, sizes, "root", "node").hint("shuffle_merge"), docs["doc_id"] == F.col("node"))
    texts = written(members.select("root", "n", "node", "text"), "members")
    final = _linked(texts, "root", "node", TEXT_BLOCK, _exact(shingle, num, den), "exact")
    leader = classes.join(final, classes["rep"] == F.col("node"), "left").select("digest", "lone", F.coalesce("root", "rep").alias("leader"))
    slim = signed.select("doc_id", "n_shingles", "digest")
    out = spread_join(slim.where("digest is not null"), leader, "digest", "doc_id", "left", "lone")
    out = out.unionByName(slim.where("digest is null").withColumn("leader", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("leader", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), shingle=4)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT ways.y, reach.root FROM reach JOIN ways ON ways.x = reach.doc_id)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
