import random

import numpy as np
import pyarrow as pa

from ledgerwell.llm import neardup
from ledgerwell.llm.bytewise import shingle_sets
from ledgerwell.llm.components import components


def brute_force(docs, k=4, num=80):
    """(n_shingles, component_id) of each row by comparing all pairs of sets."""
    sets = []
    for _, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (docs[i][0], docs[j][0]) and 100 * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(sets[i]), least.get(find(i)) if docs[i][0] is not None else None) for i in range(len(docs))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def check(spark, docs, save):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.op9_minhash_groups(spark, save(docs)).collect())
    want = sorted((str(d), n, str(c), d is None or d == c) for (d, _), (n, c) in zip(docs, brute_force(docs), strict=True))
    assert got == want


def test_groups_like_brute_force(spark, save, prose):
    rng = random.Random(2)
    docs = [(i, prose(rng.randint(20, 120))) for i in range(60)]
    for g in range(6):
        base = prose(120).split()
        docs += [(1000 * (g + 1) - i, edited(rng, base, rng.randint(0, 4))) for i in range(12)]
    docs += [(7001, docs[3][1]), (7000, docs[3][1].upper()), (7002, None), (7003, ""), (7004, " \n\t"), (7005, "a b"), (7006, "A  b"), (7007, "a b c d"), (7008, "é É x"), (None, docs[3][1]), (None, None)]
    docs += [(8000, prose(30000)), (7005, "a b")]
    check(spark, docs, save)


def test_large_group_in_blocks(spark, save, prose, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 10)
    rng = random.Random(4)
    base = prose(200).split()
    check(spark, [(i, edited(rng, base, rng.randint(0, 9))) for i in range(90)], save)


def test_empty_table(spark, save):
    assert neardup.op9_minhash_groups(spark, save([])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 1.0):
        a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        cut = int(len(a) * 2 * share / (1 + share))
        b = np.r_[a[:cut], rng.integers(0, 2**63, len(a) - cut, dtype=np.uint64)]
        fields = [(neardup.minima(x) >> np.uint64(20)) & np.uint64(15) for x in (a, b)]
        assert abs(neardup.corrected_similarity(int((fields[0] == fields[1]).sum())) - share) < 0.2
    assert neardup.corrected_similarity(72) == 1.0
    assert 30 < neardup.least_matches(0.8) < 58


def test_shingles_do_not_cross_rows():
    sets = list(shingle_sets(pa.array(["a b c d", "e f g h", None, "a b c d e", "A B C D"]), 4))
    assert [len(s) for s in sets] == [1, 1, 0, 2, 1] and sets[0][0] in sets[3] and sets[0][0] == sets[4][0]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_at_the_threshold(spark, save):
    """Of 600 pairs at a similarity of exactly 0.8 all are linked, and of 300 just below it none."""
    pairs, rows = 900, []
    for i in range(pairs):
        words = [f"p{i}w{j}" for j in range(93)]  # 90 shingles, of which 80 stay when the last 10 words change
        changed = 10 if i < 600 else 11
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-changed], *(f"p{i}x{j}" for j in range(changed))]))]
    out = {r.doc_id: r.component_id for r in neardup.op9_minhash_groups(spark, save(rows)).collect()}
    linked = sum(out[2 * i + 1] == 2 * i for i in range(600))
    assert linked == 600 and all(out[2 * i + 1] == 2 * i + 1 for i in range(600, pairs))
