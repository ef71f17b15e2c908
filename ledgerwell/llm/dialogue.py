"""Conversation structure repair by weighted finite-state composition.

Three machines are composed: an acceptor of a conversation's rows in order, a transducer of edits (keep, rerole, delete,
insert) and an acceptor of the role grammar `(s?(ua)+)?`. States of the composition are pairs (rows read, grammar state), made
as they are reached; the shortest path is taken row by row, which is a topological order, as inserts before a row never come
back to a state at a lower cost. A weight is (cost, label string), compared in that order. Label strings that lead to different
states after equally many rows differ before either ends, so that their order among the states of a row, a small number, stands
for the strings; costs are held as differences, so that few different fronts exist and each step is computed once.

No task holds a conversation. Rows are sorted by range and numbered; what a conversation has in one range is a segment, whose
weights from each state to each state are one small table; the tables of a conversation are combined in groups of FAN along a
tree, the chosen states go back down, and each segment then spells its own edits.

Rows are ordered by turn (null first), role and text. A null role or text is one space; an empty or unknown role cannot be kept;
a null conv_id is a conversation of its own; a turn may repeat; rows that repeat are duplicates; texts of any length pass as
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm.common import CRC32_SQL, spread_join, table, written

#: The grammar `(s?(ua)+)?` over role initials: where each symbol leads, and the states a text may end in.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Codes of rows: s, u, a and o (any other role) for sound ones, the capital for truncated ones, x for blanks and duplicates.
GONE = "x"
#: Tables of a conversation's segments that one task combines.
FAN = 1024
BLANKS = " \t\n\x0b\x0c\r"
#: Of each grammar state, the least cost and the place of its label string in their order; None where no path leads.
Front = tuple[tuple[int, int] | None, ...]


def edits(code: str) -> Iterator[tuple[str, str, int]]:
    """The transducer's arcs that read a row of this code: label, role initial written (none for a deletion), cost."""
    yield DELETE, "", DELETE_COST
    if code != GONE:
        own, late = code.lower(), TRUNCATED_COST * code.isupper()
        if own != "o":
            yield KEEP, own, late
        for role in ROLE:
            if role != own:
                yield REROLE, role, REROLE_COST + late


@cache
def inserted(state: int) -> dict[int, tuple[int, str]]:
    """The grammar states that inserts lead to from a state, with cost and labels."""
    reached, todo = {state: (0, "")}, [state]
    for at in todo:
        cost, labels = reached[at]
        for role in ROLE:
            to = GRAMMAR[at].get(role)
            if to is not None and to not in reached:
                reached[to] = (cost + INSERT_COST, labels + INSERT)
                todo.append(to)
    return reached


@cache
def arcs(state: int, code: str) -> list[tuple[int, str, int]]:
    """Inserts and one edit from a grammar state: cost, labels and the state they lead to."""
    out = []
    for at, (cost, labels) in inserted(state).items():
        for label, symbol, more in edits(code):
            to = GRAMMAR[at].get(symbol) if symbol else at
            if to is not None:
                out.append((cost + more, labels + label, to))
    return out


def _ranked(best: dict[int, tuple]) -> tuple[int, Front]:
    """The least cost and the front left over it, of the best (cost, order, labels, ...) by state."""
    order = {state: k for k, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    least = min(b[0] for b in best.values())
    return least, tuple((best[s][0] - least, order[s]) if s in best else None for s in range(len(GRAMMAR)))


@cache
def advance(front: Front, code: str) -> tuple[int, Front, tuple]:
    """One row read: the cost added, the next front, and by state the labels and the state they came from."""
    best: dict[int, tuple] = {}
    for state, weight in enumerate(front):
        if weight is not None:
            for cost, labels, to in arcs(state, code):
                found = (weight[0] + cost, weight[1], labels, state)
                best[to] = min(best.get(to, found), found)
    added, after = _ranked(best)
    return added, after, tuple(best[s][2:] if s in best else None for s in range(len(GRAMMAR)))


def started(state: int) -> Front:
    return tuple((0, 0) if s == state else None for s in range(len(GRAMMAR)))


def walked(codes: str, state: int) -> tuple[int, Front, list[tuple]]:
    """All rows of a segment read from a grammar state: cost, last front, steps back."""
    total, front, back = 0, started(state), []
    for code in codes:
        added, front, step = advance(front, code)
        total += added
        back.append(step)
    return total, front, back


def spelled(codes: str, start: int, end: int) -> str:
    """The labels of the least path through a segment between two grammar states."""
    parts, state = [], end
    for step in reversed(walked(codes, start)[2]):
        labels, state = step[state]
        parts.append(labels)
    return "".join(reversed(parts))


#: A segment's table: of each pair of grammar states the cost (-1: no path) and the order among those of the first state.
def weights(codes: str) -> list[int]:
    out = []
    for start in range(len(GRAMMAR)):
        total, front, _ = walked(codes, start)
        out += [x for w in front for x in ((total + w[0], w[1]) if w else (-1, -1))]
    return out


def _across(tables: list[list[int]], start: int) -> tuple[int, Front, list[tuple]]:
    """Segments passed from a grammar state, by their tables; as walked()."""
    total, front, back, n = 0, started(start), [], len(GRAMMAR)
    for t in tables:
        best: dict[int, tuple] = {}
        for state, weight in enumerate(front):
            if weight is not None:
                for to in range(n):
                    cost, order = t[2 * (n * state + to)], t[2 * (n * state + to) + 1]
                    if cost >= 0:
                        found = (weight[0] + cost, weight[1], order, state)
                        best[to] = min(best.get(to, found), found)
        added, front = _ranked(best)
        total += added
        back.append(tuple(best[s][3] if s in best else None for s in range(n)))
    return total, front, back


def combined(tables: list[list[int]]) -> list[int]:
    """The table of segments that follow each other."""
    out = []
    for start in range(len(GRAMMAR)):
        total, front, _ = _across(tables, start)
        out += [x for w in front for x in ((total + w[0], w[1]) if w else (-1, -1))]
    return out


def routed(tables: list[list[int]], start: int, end: int) -> list[tuple[int, int]]:
    """Of each segment, the grammar states at its two ends on the least path between two states."""
    out, state = [], end
    for step in reversed(_across(tables, start)[2]):
        out.append((step[state], state))
        state = step[state]
    return out[::-1]


def ended(tables: list[list[int]]) -> tuple[int, int, int]:
    """Cost of a whole conversation, the grammar state after its rows, and the inserts that follow."""
    total, front, _ = _across(tables, 0)
    ends = []
    for state, weight in enumerate(front):
        if weight is not None:
            for to, (cost, labels) in inserted(state).items():
                if to in FINAL:
                    ends.append((weight[0] + cost, weight[1], labels, state))
    cost, _, labels, state = min(ends)
    return total + cost, state, len(labels)


def damage(rows: DataFrame) -> DataFrame:
    """The query's test damage, by crc32(`conv_id:turn`) % 20: dropped, emptied, without stops, repeated, or from the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows in order, written: row rises with conv_id, turn, role and text; part is the range that holds it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.monotonically_increasing_id().alias("_id"))
    keys = ["conv_id", "turn", "role", "text", "_id"]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_id").withColumn("row", F.monotonically_increasing_id())
    trimmed = F.rtrim("text", F.lit(BLANKS))
    same = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text"), 256))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return written(dealt.withColumn("part", F.shiftright("row", 33).cast("int")).withColumn("fault", fault).withColumn("same", same), "turns")


SEGMENT = "conv_id bigint, part int, first bigint, codes string, weights array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, turns bigint, low bigint, high bigint"
LEGAL = ("su", "ua", "au")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to segments."""
    done, own, key = [], None, None

    def closed() -> dict:
        own["codes"] = "".join(own["codes"])
        return own | {"weights": weights(own["codes"])}

    def batch(found: list[dict]) -> pa.RecordBatch:
        schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(t, pa.list_(pa.int64()))) for n, t in (x.split() for x in SEGMENT.split(", "))])
        return pa.RecordBatch.from_pylist(found, schema)

    for b in batches:
        for conv, part, row, turn, symbol, fault in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "row", "turn", "symbol", "fault")), strict=True):
            if own is None or (conv, part) != key:
                if own is not None:
                    done.append(closed())
                key = conv, part
                own = {"conv_id": conv, "part": part, "first": row, "codes": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": symbol, "tail": None, "turns": 0, "low": None, "high": None}
            own["codes"].append(GONE if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
            if fault:
                own[fault] += 1
            own["illegal"] += own["tail"] is not None and own["tail"] + symbol not in LEGAL
            own["tail"] = symbol
            if turn is not None:
                own["turns"] += turn != own["high"]
                own["low"], own["high"] = turn if own["low"] is None else own["low"], turn
        if len(done) >= 2000:
            yield batch(done)
            done = []
    if own is not None:
        done.append(closed())
    yield batch(done)


def segments(rows: DataFrame) -> DataFrame:
    """The segments of numbered rows, written. Copies are told by a digest of conversation, role and text; only keys that occur
    more than once are joined back, and the rows of one key are dealt over tasks."""
    lean = rows.select("conv_id", "part", "row", "turn", "fault", "same", F.substr("role", F.lit(1), F.lit(1)).alias("initial"))
    firsts = lean.groupBy("same").agg(F.min("row").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = spread_join(lean, firsts, "same", "row", "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("row") > F.col("earliest"), "duplicate").otherwise(F.col("fault"))
    symbol = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    coded = joined.select("conv_id", "part", "row", "turn", symbol.alias("symbol"), fault.alias("fault"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(coded.repartition(parts, "conv_id", "part").sortWithinPartitions("conv_id", "part", "row").mapInArrow(_segments, SEGMENT), "segments")


def _summed(members: list) -> dict:
    """Counts of segments that follow each other."""
    total = {k: sum(m[k] for m in members) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    total["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(members, members[1:], strict=False))
    numbers = [m for m in members if m["low"] is not None]
    total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(numbers, numbers[1:], strict=False))
    return total | {"head": members[0]["head"], "tail": members[-1]["tail"], "low": numbers[0]["low"] if numbers else None, "high": numbers[-1]["high"] if numbers else None}


MEMBER = ["part", "weights", "blank", "duplicate", "truncated", "illegal", "head", "tail", "turns", "low", "high"]
GROUP = "conv_id bigint, part int, weights array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, turns bigint, low bigint, high bigint"
WHOLE = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, inserts int, routes array<struct<part:int,start:int,end:int>>"
ROUTES = "conv_id bigint, routes array<struct<part:int,start:int,end:int>>"


def _grouped(level: DataFrame, group: Column) -> DataFrame:
    """Groups of at most FAN neighbours of a level, in order."""
    return level.groupBy("conv_id", group.alias("group")).agg(F.array_sort(F.collect_list(F.struct(*MEMBER))).alias("members"))


def _lists(frame: pd.DataFrame) -> Iterator[tuple[object, list[dict]]]:
    for row in frame.itertuples(index=False):
        yield row, [{k: m[k] for k in MEMBER} for m in row.members]


def _ups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame([{"conv_id": r.conv_id, "part": r.group, "weights": combined([m["weights"] for m in ms])} | _summed(ms) for r, ms in _lists(f)], columns=[c.split()[0] for c in GROUP.split(", ")], dtype=object)


def _tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r, ms in _lists(f):
            tables, s = [m["weights"] for m in ms], _summed(ms)
            cost, state, inserts = ended(tables)
            gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
            routes = [(m["part"], a, b) for m, (a, b) in zip(ms, routed(tables, 0, state), strict=True)]
            out.append((r.conv_id, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, inserts, routes))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WHOLE.split(", ")], dtype=object)


def _downs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r, ms in _lists(f):
            ends = routed([m["weights"] for m in ms], r.start, r.end)
            out.append((r.conv_id, [(m["part"], a, b) for m, (a, b) in zip(ms, ends, strict=True)]))
        yield pd.DataFrame(out, columns=["conv_id", "routes"], dtype=object)


def _spell(codes: pd.Series, start: pd.Series, end: pd.Series, inserts: pd.Series) -> pd.Series:
    return pd.Series([spelled(c, s, e) + INSERT * i for c, s, e, i in zip(codes, start, end, inserts, strict=True)], dtype=object)


class Repair:
    """rows: numbered rows; conversations: one row each (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit);
    pieces: the edits of each segment (conv_id, part, first, start, edits)."""

    def __init__(self, rows: DataFrame, fan: int = FAN):
        self.rows = numbered(rows)
        found = segments(self.rows)
        levels, width = [found], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while width > fan:
            levels.append(written(_grouped(levels[-1], F.floor(F.col("part") / fan).cast("int")).mapInPandas(_ups, GROUP), "level"))
            width = -(-width // fan)
        whole = written(_grouped(levels[-1], F.lit(0)).mapInPandas(_tops, WHOLE), "whole")
        routes = whole.select("conv_id", F.explode("routes").alias("r")).select("conv_id", "r.*")
        for level in levels[-2::-1]:
            of = routes.select(F.col("conv_id").alias("of"), F.col("part").alias("group"), "start", "end")
            groups = _grouped(level, F.floor(F.col("part") / fan).cast("int"))
            down = groups.join(of, F.col("conv_id").eqNullSafe(F.col("of")) & (groups["group"] == of["group"])).select("conv_id", "members", "start", "end")
            routes = down.mapInPandas(_downs, ROUTES).select("conv_id", F.explode("routes").alias("r")).select("conv_id", "r.*")
        last = whole.select(F.col("conv_id").alias("c"), F.element_at("routes.part", -1).alias("top"), "inserts")
        if len(levels) > 1:  # the last segment of a conversation gets the inserts that follow
            lasts = found.groupBy(F.col("conv_id").alias("c")).agg(F.max("part").alias("top"))
            last = lasts.alias("l").join(last.alias("w"), F.expr("l.c <=> w.c")).select("l.c", "l.top", "w.inserts")
        s, r, w = found.alias("s"), routes.alias("r"), last.alias("w")
        joined = s.join(r, F.expr("s.conv_id <=> r.conv_id and s.part = r.part")).join(w, F.expr("s.conv_id <=> w.c and s.part = w.top"), "left")
        spell = F.pandas_udf(_spell, "string")
        made = spell("s.codes", "r.start", "r.end", F.coalesce("w.inserts", F.lit(0)))
        self.pieces = written(joined.select("s.conv_id", "s.part", "s.first", "r.start", made.alias("edits")), "edits")
        audits = self.pieces.groupBy(F.col("conv_id").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "edits"))), lambda x: x["edits"]), "").alias("audit"))
        self.conversations = whole.join(audits, F.expr("conv_id <=> c")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _merged(self, *by: str) -> DataFrame:
        """Each segment's edits before its rows, dealt by key, in order."""
        texts = self.rows.select("conv_id", "part", "row", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("edits"), "role", "text")
        heads = self.pieces.select("conv_id", "part", F.col("first").alias("row"), "start", "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        parts = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return texts.unionByName(heads).repartition(parts, *by).sortWithinPartitions(*by, "row", F.col("edits").isNull())

    def repaired(self) -> DataFrame:
        """The repaired rows: conv_id, part, place (they order a conversation's rows), edit, role, text."""
        return self._merged("conv_id", "part").mapInArrow(_edited, "conv_id bigint, part int, place bigint, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id and the SHA-256 of a conversation's repaired rows, `role:text` joined by newlines, read in a stream."""
        return self._merged("conv_id").mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Merged rows to (conv_id, part, edit, role, text); one without a role for each segment that begins, and for each deletion."""
    labels, at, state, key = "", 0, 0, (None, None)

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(labels) and labels[at] == INSERT:
            symbol = next(s for s in ROLE if s in GRAMMAR[state])
            state, at = GRAMMAR[state][symbol], at + 1
            yield *key, INSERT, ROLE[symbol], ""

    for b in batches:
        for conv, part, start, found, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "start", "edits", "role", "text")), strict=True):
            yield from inserts()
            if found is not None:
                labels, at, state, key = found, 0, start, (conv, part)
                yield *key, None, None, None
                yield from inserts()
                continue
            label, at = labels[at], at + 1
            if label == DELETE:
                yield *key, DELETE, None, None
                continue
            symbol = role[0] if label == KEEP else next(s for s in ROLE if s in GRAMMAR[state])
            state = GRAMMAR[state][symbol]
            yield *key, label, role if label == KEEP else ROLE[symbol], text
    yield from inserts()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, schema = ["conv_id", "part", "place", "edit", "role", "text"], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    rows, size, place = [], 0, 0
    for conv, part, edit, role, text in _applied(batches):
        if edit is None:
            place = 0
        elif edit != DELETE:
            rows.append(dict(zip(names, (conv, part, place, edit, role, text), strict=True)))
            place, size = place + 1, size + len(text)
            if size > 4 << 20 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, key, digest, lines = [], None, None, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])

    for conv, _, _, role, text in _applied(batches):
        if digest is None or conv != key:
            if digest is not None:
                out.append((key, digest.hexdigest()))
            key, digest, lines = conv, hashlib.sha256(), 0
            if len(out) >= 10_000:
                yield batch()
                out = []
        if role is not None:
            digest.update(f"{chr(10) * (lines > 0)}{role}:{text}".encode())
            lines += 1
    if digest is not None:
        out.append((key, digest.hexdigest()))
    yield batch()


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = Repair(damage(rows))
    ids = rows.groupBy(F.col("conv_id").alias("id")).agg(F.lit(1).alias("one")).drop("one")
    none = hashlib.sha256(b"").hexdigest()
    both = repair.conversations.alias("r").join(repair.digests().alias("d"), F.expr("r.conv_id <=> d.conv_id")).select("r.*", "d.repaired_sha256")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(both, F.expr("id <=> conv_id"), "left").select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )


_BLANK = "[\\x20\\x09-\\x0D]"
OP11_SQL = f"""
WITH RECURSIVE spaced AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
    SELECT k, {CRC32_SQL.format(bytes="list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)")} % 20 AS kind FROM (SELECT DISTINCT k FROM spaced)
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM spaced JOIN kinds USING (k) WHERE kind <> 0
), ids AS (
    SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), ordered AS (
    SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
), faults AS (
    SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS symbol,
        CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?]{_BLANK}*\\z') THEN 'truncated' ELSE '' END AS fault
    FROM ordered
), marked AS (
    SELECT *, lag(symbol) OVER (PARTITION BY c ORDER BY i) || symbol AS pair, fault IN ('blank', 'duplicate') AS gone, fault = 'truncated' AS late FROM faults
), grammar(q, symbol, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts AS (
    SELECT q, q AS q2, 0 AS n FROM (VALUES (0), (1), (2), (3)) t(q)
    UNION ALL SELECT i.q, g.q2, n + 1 FROM inserts i JOIN grammar g ON g.q = i.q2 WHERE symbol <> 's' AND n < 3
), edits AS (
    SELECT r.symbol, gone, late, g.q, g.q2, CASE WHEN r.symbol = g.symbol THEN 'K' ELSE 'R' END AS label, (r.symbol <> g.symbol)::INT + 5 * late::INT AS cost
    FROM (SELECT DISTINCT symbol, gone, late FROM marked) r JOIN grammar g ON NOT gone AND (r.symbol = g.symbol OR g.symbol <> 's')
    UNION ALL SELECT symbol, gone, late, q, q, 'D', 2 FROM (SELECT DISTINCT symbol, gone, late FROM marked), (VALUES (0), (1), (2), (3)) t(q)
), arcs AS (
    SELECT symbol, gone, late, i.q, e.q2, repeat('I', n) || label AS labels, cost + 5 * n AS cost FROM edits e JOIN inserts i ON i.q2 = e.q
), walk AS (
    SELECT c, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM ids
    UNION ALL
    SELECT c, i, q, best.cost, best.audit FROM (
        SELECT w.c, r.i, a.q2 AS q, min({{'cost': w.cost + a.cost, 'audit': w.audit || a.labels}}) AS best
        FROM walk w JOIN marked r ON r.c = w.c AND r.i = w.i + 1 JOIN arcs a ON a.q = w.q AND a.symbol = r.symbol AND a.gone = r.gone AND a.late = r.late
        GROUP BY w.c, r.i, a.q2)
), lengths AS (
    SELECT ids.c, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM ids LEFT JOIN marked USING (c) GROUP BY ids.c
), ends AS (
    SELECT w.c, min({{'cost': w.cost + 5 * f.n, 'audit': w.audit || repeat('I', f.n)}}) AS best
    FROM walk w JOIN lengths l ON l.c = w.c AND l.n = w.i JOIN inserts f ON f.q = w.q AND f.q2 IN (0, 3) GROUP BY w.c
), labels AS (
    SELECT c, p, substr(best.audit, p, 1) AS label, best.audit AS audit FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS p FROM ends)
), placed AS (
    SELECT c, p, label, count(*) FILTER (label <> 'I') OVER (PARTITION BY c ORDER BY p) AS i, count(*) FILTER (label <> 'D') OVER (PARTITION BY c ORDER BY p) AS k FROM labels
), kept AS (
    SELECT x.c, p, label, k, role, text, max((label = 'K' AND k = 1 AND symbol = 's')::INT) OVER (PARTITION BY x.c) AS system
    FROM placed x LEFT JOIN marked m ON m.c = x.c AND m.i = x.i AND label <> 'I' WHERE label <> 'D'
), texts AS (
    SELECT c, string_agg(CASE WHEN label = 'K' THEN role WHEN (k - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE label WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM kept GROUP BY c
)
SELECT conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids JOIN lengths USING (c) JOIN ends USING (c) LEFT JOIN texts USING (c)
"""
