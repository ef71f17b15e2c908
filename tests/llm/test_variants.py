import random
import re
import zlib
from collections import Counter

import duckdb

from ledgerwell.llm import variants
from ledgerwell.llm.queries import ORACLE


def counted(docs):
    """The vocabulary by plain counting."""
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def wanted(n):
    """Every pair of words compared."""
    by = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(by[w]), n.get(form[w]))
    return out


def documents(rng):
    letters = "aabébÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    docs = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = stems[min(rng.randrange(60), rng.randrange(60))]
            if rng.random() < 0.4:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "a", "x"]) + w[k + rng.randrange(2) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i if i % 50 else None, rng.choice([" ", ", ", "1", "×"]).join(words)))
    long = "q" * 3000 + "abc" * 500
    return docs + [(7, None), (8, ""), (9, "Āµ 1234")] + [(1000 + k, f"{long} {long[:-1]} {long}x {long[:50]}z{long[51:]}") for k in range(3)] + docs[:20]


def got(out):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


def test_variants_equal_all_pairs(spark, save):
    docs = documents(random.Random(4))
    out = variants.op12_spelling_variants(spark, save(docs)).collect()
    want = wanted(counted(docs))
    assert len(out) == len(want) > 300 and got(out) == want
    assert any(f is not None and f != r for f, r, *_ in want.values()) and any(len(w) > 4000 for w in want)


def test_long_chains_of_forms(spark):
    chain = [("a" * k + "b" * (12 - k), 3 * 2**k) for k in range(13)]
    words = spark.createDataFrame(chain, "word string, n bigint").withColumn("rank", -variants.F.col("n"))
    assert got(variants.variants(words).collect()) == wanted(dict(chain))


def test_small_batches_of_keys(monkeypatch):
    words = ["aabba", "é" * 9, "z", "abcdefgh"]
    keys, number, kind = variants.group_keys(words)
    assert len({tuple(k) for k in keys.tolist()}) == len(keys)
    for k, w in enumerate(words):
        alone = variants.group_keys([w])
        mine = number == k
        assert {(*a, b) for a, b in zip(keys[mine].tolist(), kind[mine].tolist())} == {(*a, b) for a, b in zip(alone[0].tolist(), alone[2].tolist())}
    shorter = keys[(kind == variants.SHORTER) & (number == 0)].tolist()
    assert sorted(shorter) == sorted(variants.group_keys(["abba", "aaba", "aabb"])[0][:3].tolist())


def test_nothing(spark, save):
    assert variants.op12_spelling_variants(spark, save([])).count() == 0


def test_sql(spark, save):
    docs = documents(random.Random(12))[:250]
    path = save(docs)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    rows = duckdb.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({ORACLE['op12_spelling_variants']})").fetchall()
    assert {r[0]: r[1:] for r in rows} == wanted(counted(docs)) and len(rows) > 100
