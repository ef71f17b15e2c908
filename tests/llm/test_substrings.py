import random

from ledgerwell.llm import substrings
from ledgerwell.llm.substrings import brute_force


def check(spark, docs, save):
    got = sorted(tuple(r) for r in substrings.op6_substring_dedup(spark, save(docs)).collect())
    assert got == sorted(brute_force(docs))


def made(rng):
    chars = "abcdefé ñ\n"
    text = lambda n: "".join(rng.choice(chars) for _ in range(n))
    passage, line = text(130), text(101)
    docs = [(i, text(rng.randint(0, 400))) for i in range(30)]
    docs += [(100 + i, text(rng.randint(0, 150)) + passage[rng.randint(0, 30) : rng.randint(105, 130)] + text(rng.randint(0, 150))) for i in range(30)]
    docs += [(200 + i, text(20) + line * 3 + text(20)) for i in range(5)]
    docs += [(300, None), (301, ""), (302, "a" * 500), (303, "ab" * 300), (304, "a" * 99), (305, "a" * 100), (306, docs[3][1] + docs[40][1]), (50, "x" + passage)]
    return docs


def test_like_brute_force(spark, save):
    check(spark, made(random.Random(1)), save)


def test_hot_keys_spread(spark, save, monkeypatch):
    docs = made(random.Random(6))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.dedup_substrings(rows, hot=2, digest=True).collect())
    assert got == sorted(w[:4] for w in brute_force(docs))


def test_kept_bytes_and_same_rows(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("xyz ") for _ in range(300))
    rows = spark.createDataFrame([(1, text), (1, text), (2, "q" + text), (None, text)], "doc_id bigint, text string")
    out = {r.doc_id: (r.n_removed, bytes(r.kept).decode()) for r in substrings.dedup_substrings(rows).collect()}
    assert out[1] == (0, text) and out[2] == (300, "q") and out[None] == (300, "")
    assert substrings.dedup_substrings(rows.limit(0)).count() == 0


def test_rows_without_or_with_a_shared_id(spark):
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice("uvwxyz ") for _ in range(n))
    shared, twin = made(150), made(200)
    docs = [(1, shared + made(30)), (2, made(20) + shared), (2, made(180)), (3, twin), (None, made(10) + shared), (None, made(400)), (None, made(5) + twin), (None, "x"), (4, twin), (4, twin)]
    again = made(300)
    docs += [(None, again)] * 3
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substrings.dedup_substrings(rows).collect())
    want = [(1, 180, 0), (2, 170, 150), (2, 180, 0), (3, 200, 0), (None, 160, 150), (None, 400, 0), (None, 205, 200), (None, 1, 0), (4, 200, 200), (4, 200, 200), (None, 300, 0), (None, 300, 300), (None, 300, 300)]
    assert got == sorted((str(d), n, gone) for d, n, gone in want)
    plain = [(1, shared), (1, made(120)), (2, shared)]
    got = sorted((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(plain, "doc_id bigint, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 150)]


def test_other_lengths(spark):
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("ab") for _ in range(60))) for i in range(30)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in substrings.dedup_substrings(rows, length=12, prefix_length=6, digest=True).collect())
    assert got == sorted((w[0], w[2], w[3]) for w in brute_force(docs, 12))


def test_plain_doubling_agrees(spark):
    docs = made(random.Random(12))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    later = substrings.doubled_ranks(rows).where("did <> first_did or p <> first_p").groupBy("did").count().collect()
    seen, want = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - 99):
            want[d] = want.get(d, 0) + (raw[p : p + 100] in seen)
            seen.add(raw[p : p + 100])
    assert {r.did: r["count"] for r in later} == {d: n for d, n in want.items() if n}
