from collections import Counter, defaultdict

import duckdb
import pytest

from ledgerwell.llm import mixing, quality


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix(spark, save, prose):
    docs = [(i, prose(5 + i % 90), None, ["a", "b", "é", "z", None][i % 5] if i % 3 else "a") for i in range(1500)]
    docs += [(2000, None, None, "a"), (2001, "  ", None, "b"), (2002, prose(3000), None, "small"), (None, prose(40), None, "b"), (None, prose(40), None, "b")] + docs[:3] * 40
    path = save(docs)
    out = mixing.op10_mix_sources(spark, path).collect()
    assert len(out) == len(docs)
    source = {d: s for d, _, _, s in docs}
    sizes, taken, target = defaultdict(int), Counter(), {}
    for d, t, _, s in docs:
        sizes[s] += len((t or "").split())
    for r in out:
        s = source[r.doc_id] if r.doc_id is not None else "b"
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and r.source_size == sizes[s]
        taken[s] += r.taken
        target[s] = r.target
    want = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= (1500 if s == "small" else 60)
    again = mixing.op10_mix_sources(spark, path).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_a_row_repeated_very_often(spark, save, monkeypatch):
    docs = [(None, "w w", None, "a")] * 500 + [(7, "w", None, "a")] * 95 + [(i, "w w w", None, "b") for i in range(100, 200)]
    path = save(docs)
    want = sorted(map(str, mixing.op10_mix_sources(spark, path).collect()))
    monkeypatch.setattr(mixing, "COPIES", 30)
    assert sorted(map(str, mixing.op10_mix_sources(spark, path).collect())) == want and len(want) == len(docs)


def test_mix_of_nothing(spark, save):
    assert mixing.op10_mix_sources(spark, save([])).count() == 0


def test_mix_without_words(spark, save):
    out = mixing.op10_mix_sources(spark, save([(1, None, None, None), (2, "", None, "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in out] == [(0, 0, 0.0, 0)] * 2


def test_expected_copies_are_unbiased(spark):
    rows = spark.createDataFrame([(i, "w " * 10, "a" if i % 4 else "b") for i in range(400)], "doc_id bigint, text string, source string")
    seen = Counter()
    for seed in range(6):
        for r in mixing.mix(rows, seed=seed).collect():
            seen[r.doc_id] += r.copies
    rate = sum(seen[i] for i in range(400) if i % 4) / 300 / 6
    assert rate == pytest.approx((4000 * 5 / 7) / 3000, abs=0.35) and len({seen[i] for i in range(400) if i % 4}) > 1


def measured(text):
    words = (text or "").split()
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(tri)
    covered = {p for i, t in enumerate(tri) if c[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def test_metrics_like_brute_force(spark, save, prose):
    texts = [None, "", " \n\t ", "a b c", "a b c a b c", "a a a a a", "x y\nx y\n\n x y\nx y", "#*$ %&| <>é", prose(80), (prose(20) + "\n") * 6, "w " * 30000, prose(60) + " " + "p q r s " * 30]
    docs = [(i, t, None, None if i % 4 == 0 else "h") for i, t in enumerate(texts)] + [(3, texts[3], None, "h")]
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.op5_quality_rules(spark, save(docs)).collect())
    want = sorted((d, *(m := measured(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for d, t, _, _ in docs)
    assert got == want


def test_hosts_are_judged_and_clean_documents_stay(spark, save, prose):
    docs = [(i, prose(80), None, f"good{i % 6}") for i in range(300)] + [(1000 + i, prose(80) if i % 20 == 0 else "too short", None, "bad") for i in range(200)]
    out = {r.doc_id: r for r in quality.op5_quality_rules(spark, save(docs)).collect()}
    assert all(out[i].kept for i in range(300))
    assert not any(out[1000 + i].kept for i in range(200)) and not out[1000].base_failed


@pytest.mark.parametrize(
    "rates, gone",
    [
        # hosts that differ much make a wide prior: only one that fails on most documents goes
        ({f"good{k}": (0.04, 100) for k in range(12)} | {"most": (0.6, 150), "third": (0.33, 400), "tenth": (0.1, 200), "tiny": (1.0, 1), None: (0.0, 50)}, {"most"}),
        # among hosts that agree, one that is far off goes earlier, but for few documents or a small share
        ({f"good{k}": (0.04, 100) for k in range(40)} | {"far": (0.4, 200), "tenth": (0.12, 200), "tiny": (1.0, 2)}, {"far"}),
    ],
)
def test_limits_follow_the_prior(spark, save, prose, rates, gone):
    good = prose(60)
    docs = [(k * 1000 + i, "too short" if i < rate * n else f"{good} {k} {i}", None, host) for k, (host, (rate, n)) in enumerate(rates.items()) for i in range(n)]
    path = save(docs)
    kept = {r.doc_id: r.kept for r in quality.op5_quality_rules(spark, path).collect()}
    for host in rates:
        clean = {kept[d] for d, t, _, h in docs if h == host and t != "too short"}
        assert clean == (set() if rates[host][0] == 1 else {host not in gone}), host
    verdict = {r.source: r for r in quality.host_verdicts(quality.rule_failures(quality.document_metrics(spark.read.parquet(f"{path}/documents.parquet")))).collect()}
    assert {h for h, v in verdict.items() if v.rejected} == gone and verdict["tiny"].rate_short < 0.9
    assert all(quality.LEAST <= v.limit_short <= quality.MOST for v in verdict.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT doc_id, kept FROM ({quality.OP5_SQL})").fetchall()
    assert dict(found) == kept


@pytest.mark.parametrize("hosts", [["a"], ["a", "b"], ["a", "a", "b"], [None, "b", "c"]])
def test_few_hosts(spark, save, prose, hosts):
    docs = [(k, "too short" if k == 0 else prose(60), None, host) for k, host in enumerate(hosts)]
    path = save(docs)
    kept = {r.doc_id: r.kept for r in quality.op5_quality_rules(spark, path).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert dict(con.execute(f"SELECT doc_id, kept FROM ({quality.OP5_SQL})").fetchall()) == kept and not kept[0] and len(kept) == len(hosts)


def test_quality_of_empty_table(spark, save):
    assert quality.op5_quality_rules(spark, save([])).count() == 0
