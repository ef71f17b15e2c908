import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import duckdb
import pyarrow as pa
import pytest

from ledgerwell.llm import dialogue
from ledgerwell.llm.queries import ORACLE

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(codes, insert=5):
    """The least (cost, audit) by plain recursion over what is left to read."""

    @cache
    def left(i, shape, inserts):
        """shape: what was written so far, as one of the four prefixes that matter."""
        best = [] if shape not in ("", "ua") or i < len(codes) else [(0, "")]
        wanted = {"": "su", "s": "u", "u": "a", "ua": "u"}[shape]
        after = {"s": "s", "u": "u", "a": "ua"}
        if inserts < 3:
            best += [(c + insert, "I" + x) for role in "ua" if role in wanted for c, x in [left(i, after[role], inserts + 1)]]
        if i < len(codes):
            symbol, fault = codes[i]
            c, x = left(i + 1, shape, 0)
            best.append((c + 2, "D" + x))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                for role in wanted:
                    if symbol == role or role in "ua":
                        c, x = left(i + 1, after[role], 0)
                        best.append((c + late + (symbol != role), ("K" if symbol == role else "R") + x))
        return min(best, default=(10**9, ""))

    for i in range(len(codes), 0, -1):  # from the end, so that no call goes deep
        for shape in ("", "s", "u", "ua"):
            left(i, shape, 0)
    return left(0, "", 0)


def repaired(rows):
    """What the query returns for a conversation's rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, codes, faults = set(), [], Counter()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        codes.append((role[:1], fault))
    cost, audit = cheapest(tuple(codes))
    out, k = [], 0
    for label in audit:
        own = rows[k][2] if label in "KRD" else ""
        if label in "RI":
            own = "assistant" if out and out[-1][0].startswith("u") else "user"
        if label != "D":
            out.append((own, rows[k][3] if label != "I" else ""))
        k += label != "I"
    turns = {t for _, t, _, _ in rows if t is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def wanted(rows):
    after = damaged(rows)
    return {c: repaired([r for r in after if r[0] == c])[0] for c in {r[0] for r in rows}}


def odd_rows(rng):
    texts = ["Yes.", "No!", "what", "why? ", "", " \t\r\n", None, "a.b", "é.\x0b", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "usher", "User"]
    rows = [(c, t, rng.choice(roles[:5] if c % 2 else roles), rng.choice(texts[: 2 + c % 9]) if c % 3 else f"t{t}.") for c in range(120) for t in range(rng.randrange(0, 14))]
    rows += [(None, t, "user", "Null.") for t in (None, None, 3, 9)] + [(500, None, "assistant", "A.")] * 7 + [(501, t, r, x) for t in (1, 1, None) for r in "ab" for x in "xy"]
    rows += [(600, t, ("user", "assistant", "assistant")[t % 3], f"w{t % 40}{'.!' if t % 5 else ''}") for t in range(400)]
    return rows


def got(out):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}


def test_repairs_equal_plain_recursion(spark, save):
    rows = odd_rows(random.Random(5))
    out = dialogue.op11_conversation_repair(spark, save(rows, "conversations", SCHEMA)).collect()
    want = wanted(rows)
    assert len(out) == len(want) and got(out) == want
    assert {"K", "R", "D"} <= set("".join(w[6] for w in want.values()))


@pytest.mark.parametrize("fan", [2, 1024])
def test_a_conversation_over_many_ranges(spark, save, monkeypatch, fan):
    rng = random.Random(fan)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["One.", "two", "", f"t{t}.", f"t{t}"])) for t in range(500)]
    rows += [(c, t, "user", "Hi.") for c in range(9) if c != 7 for t in range(3)]
    path = save(rows, "conversations", SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        monkeypatch.setattr(dialogue.Repair.__init__, "__defaults__", (fan,))
        assert got(dialogue.op11_conversation_repair(spark, path).collect()) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repaired_rows(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("assistant", "Hi."), ("assistant", "Well."), ("user", "Bye."), ("user", "no")])] + [(2, 0, "assistant", "Lone.")]
    repair = dialogue.Repair(spark.createDataFrame(rows, SCHEMA))
    out = sorted(repair.repaired().collect(), key=lambda r: (r.conv_id, r.part, r.place))
    for conv in (1, 2):
        assert [(r.role, r.text) for r in out if r.conv_id == conv] == repaired([r for r in rows if r[0] == conv])[1]
        assert "".join(r.edit for r in out if r.conv_id == conv) == next(r.audit for r in repair.conversations.collect() if r.conv_id == conv).replace("D", "")


def test_empty_table(spark, save):
    assert dialogue.op11_conversation_repair(spark, save([], "conversations", SCHEMA)).count() == 0


@pytest.mark.parametrize("insert", [5, 1])
def test_the_algebra(monkeypatch, insert):
    """Inserts are never cheapest at their price of 5, so a lower one is tested too."""
    rng, cached = random.Random(3), (dialogue.inserted, dialogue.arcs, dialogue.advance)
    monkeypatch.setattr(dialogue, "INSERT_COST", insert)
    for f in cached:
        f.cache_clear()
    seen = set()
    for _ in range(300):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 12)))
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(3))
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        tables = [dialogue.weights(p) for p in pieces]
        assert dialogue.combined(tables) == dialogue.weights(codes)
        cost, state, inserts = dialogue.ended(tables)
        audit = "".join(dialogue.spelled(p, *r) for p, r in zip(pieces, dialogue.routed(tables, 0, state))) + "I" * inserts
        assert (cost, audit) == cheapest(tuple((c.lower(), "blank" if c == "x" else "truncated" if c.isupper() else "") for c in codes), insert)
        seen |= set(audit)
    assert ("I" in seen) == (insert == 1)
    for f in cached:
        f.cache_clear()


def test_inserted_rows_are_written():
    """A segment's inserts go before, between and after its rows, in the roles that the grammar wants."""
    heads = {"conv_id": [1, 1, 1], "part": [0, 0, 0], "start": [0, None, None], "edits": ["IKDII", None, None], "role": [None, "assistant", "user"], "text": [None, "Hi.", "x"]}
    made = list(dialogue._applied(iter([pa.RecordBatch.from_pydict(heads)])))
    assert [m[3:] for m in made if m[3]] == [("user", ""), ("assistant", "Hi."), ("user", ""), ("assistant", "")]


def test_sql(spark, save):
    rows = odd_rows(random.Random(11))
    path = save(rows, "conversations", SCHEMA)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: r[1:] for r in duckdb.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE['op11_conversation_repair']})").fetchall()}
    assert found == wanted(rows)
