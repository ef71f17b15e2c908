import hashlib
import math
import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerwell.llm import pii, spans
from ledgerwell.llm.queries import ORACLE, QUERIES

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base(text):
    """(kind, start, end, entity) by the patterns as they are stated."""
    out = []
    for k, (pattern, ok) in enumerate([
        (EMAIL, lambda m: True), (IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        (CARD, lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))), (PHONE, lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]):
        for m in re.finditer(pattern, text or ""):
            if ok(m[0]):
                value = m[0].lower() if k < 2 else re.sub("[^0-9]", "", m[0])
                out.append((k, m.start(), m.end(), f"{pii.KINDS[k]}:{value}", m[0]))
    return out


TERM = re.compile(r"[^\W\d_][^\W_]{2,}")


def sanitised(docs):
    """Added spans by document, from the definitions."""
    found = [base(t) for _, t in docs]
    together, contexts, n_entity = defaultdict(set), defaultdict(set), defaultdict(set)
    for row, (_, text) in enumerate(docs):
        for k, s, e, entity, _m in found[row]:
            n_entity[entity].add(row)
            others = [(a, z) for a, z in ((m.start(), m.end()) for m in re.finditer((EMAIL, IP, CARD, PHONE)[k], text))]
            before = max([z for a, z in others if z <= s], default=0)
            after = min([a for a, z in others if a >= e], default=len(text))
            left = TERM.findall(text[max(before, s - 200):s].lower())[-8:]
            right = TERM.findall(text[e:min(after, e + 200)].lower())[:8]
            for t in set(left + right):
                for key in (t, t[:3] + "*"):
                    together[entity, key].add(row)
                    contexts[entity, key].add((*left, "|", *right))
    words = [set(TERM.findall((t or "").lower())) for _, t in docs]
    n_with = lambda key: sum(any(w.startswith(key[:-1]) for w in ws) if key.endswith("*") else key in ws for ws in words)
    action, n = {}, len(docs)
    for (entity, t), rows in together.items():
        c = len(n_entity[entity])
        if t.endswith("*") or len({tuple(x for x in ctx if x != "|") for ctx in contexts[entity, t]}) < 2 or c * 100 > n:
            continue
        high = lambda key: math.log2((len(together[entity, key]) + c / n) / (n_with(key) + 1) * n / c) >= 0.9 * math.log2(n / c)  # noqa: B023, E731
        if high(t):
            action[t] = "removed" if high(t[:3] + "*") or action.get(t) == "removed" else "general"
    out = []
    for row, (_, text) in enumerate(docs):
        hits = [(m.start(), m.end(), action[m[0].lower()]) for m in TERM.finditer(text or "") if m[0].lower() in action]
        out.append(sorted((a, s, e) for s, e, a in hits if all(e <= b[1] or b[2] <= s for b in found[row])))
    return found, out


def wanted(docs):
    rows = []
    for (doc_id, _), found, added in zip(docs, *sanitised(docs)):
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, *_ in found)
        more = ",".join(f"{a}:{s}:{e}" for a, s, e in added)
        counts = [sum(f[0] == k for f in found) for k in range(4)]
        rows.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), ",".join(x for x in (joined, more) if x)))
    return sorted(map(str, rows))


ODD = [
    "a@b.c_d@e.f, x@y..z q@w.e.r. @a.b %@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.00.1 1.2.3 00256.1.1.1 9.9.9.9", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000 41111111111111111111111 1 2 3",
    "+1 (017) 555-7713 +12 345 +1234567890123456 ++49(0)30.1234567- +5", None, "", "é" * 50 + "ü@x.de ş+4915112345678", "Straße x@y.zz\n1.1.1.1\t5500000000000004",
]


def corpus(rng):
    common = ["the", "and", "with", "order", "shipped", "today", "please", "reply", "über", "naïve", "contact"]
    docs = [(i, " ".join(rng.choice(common) for _ in range(rng.randrange(3, 40)))) for i in range(900)]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs += [(1000 + k, f"{say(9)} Zanthor Quillfeather {say(2)} zq@mail.example {say(12)}") for k in range(6)]
    docs += [(1100 + k, f"{say(20)} Zanthor alone {say(k)}") for k in range(1)]
    docs += [(1200 + k, f"{say(4)} Zanzibar Zantac zans {say(9)}") for k in range(30)]
    docs += [(1300 + k, f"copied page of Mirabel {'4111 1111 1111 1111'} in full") for k in range(7)]
    docs += [(1400 + k, f"{say(5)} unsubscribe at info@list.example {say(5)}") for k in range(60)]
    docs += [(1500 + k, f"{say(3)} Orlin, Orlin! call +1 (017) 555-7713 or 10.0.0.1 {say(3)} orlin@x.yz") for k in range(4)]
    docs += [(None, t) for t in ODD] + [(7, ODD[0])] * 3
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus(random.Random(2))


def test_spans_equal_the_definition(spark, save, docs):
    out = QUERIES["op13_private_data"](spark, save([(i, t) for i, t in docs])).collect()
    got = sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans)) for r in out)
    want = wanted(docs)
    assert got == want
    text = "\n".join(want)
    assert "general:" in text and "removed:" in text


def test_sanitised_texts(spark, docs):
    frame = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in docs], "doc_id bigint, text string, n_chars int, `row` string")
    out = [r for r in pii.sanitise(frame).collect() if r.doc_id is not None]
    assert len(out) == sum(i is not None for i, _ in docs) and all(r.row == "x" and r.n_chars == len(r.text) for r in out)
    by = {r.doc_id: r.text for r in out}
    assert "zq@mail" not in by[1000] and "[EMAIL]" in by[1000] and "uillfeather" not in by[1000] and "Zan*" in by[1000] and "Zan* alone" in by[1100]
    assert by[1300] == "copied page of Mirabel [CARD] in full" and by[1200] == dict(docs)[1200]
    assert "unsubscribe at [EMAIL]" in by[1400] and "[PHONE] or [IP]" in by[1500]


def test_clean_documents_and_nothing(spark, save):
    path = save([(i, f"plain text {i} of words only") for i in range(40)])
    assert all(r.spans == "" for r in pii.op13_private_data(spark, path).collect())


def test_empty_table(spark, save):
    assert pii.op13_private_data(spark, save([])).count() == 0


def test_long_texts_take_linear_time(spark):
    rng = random.Random(1)
    text = " ".join(f"u{k}@h{k % 7}.example.com {rng.randrange(256)}.1.2.{k % 256} w{k}" for k in range(20_000)) + "9" * 200_000 + "a" * 200_000
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.time()
    r = pii.sanitised_spans(frame).select(F.size("base").alias("n"), F.element_at("base", 20_000).alias("last")).first()
    assert r.n == 40_000 and text[r.last.start : r.last.end] == f"u19999@h{19999 % 7}.example.com"
    assert time.time() - start < 30


def test_merged_and_replaced(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("abcé𝄞 ") for _ in range(rng.randrange(0, 9000)))
        cut = sorted((a, min(len(text), a + rng.choice([1, 5, 80])), str(k)) for k in range(rng.randrange(0, 300)) if text for a in [rng.randrange(len(text))])
        rows.append((text, cut))
    frame = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,mask:string>>").coalesce(1)
    for (text, cut), r in zip(rows, frame.select(spans.replaced(F.col("text"), F.col("spans")).alias("t")).collect(), strict=True):
        out, at = [], 0
        joined = []
        for s, e, m in cut:
            if joined and s < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e, m])
        for s, e, m in joined:
            out += [text[at:s], m]
            at = e
        assert r.t == "".join(out) + text[at:]


def test_sql(save, docs):
    path = save([(i, t) for i, t in docs])
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    rows = duckdb.sql(f"SELECT doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans FROM ({ORACLE['op13_private_data']})").fetchall()
    assert sorted(map(str, rows)) == wanted(docs)
