import random
import time
import tracemalloc

from ledgerwell.llm import decontam

ITEMS = [(1, "a b c d e f g h i j k l"), (2, "x y"), (3, None), (4, "..."), (None, "b c d e f g h i j k"), (10, "A B c d e f g h i J"), (2, "x y")]
DOCS = [
    (1, "zero a b, c d e f g h i j k l end"),
    (2, None),
    (3, ""),
    (4, "x y x y x"),
    (5, "A B C D E F G H I J"),
    (5, "A B C D E F G H I J"),
    (6, "a b c d e f g h i"),
    (7, "é y x  y!" + " filler" * 30000 + " b c d e f g h i j k"),
    (None, "x y"),
    (8, "a b c d e f g h i j k l m x y"),
]


def test_like_brute_force(spark, tmp_path):
    spark.createDataFrame([(*d, "s") for d in DOCS], "doc_id bigint, text string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in decontam.op1_decontamination(spark, str(tmp_path)).collect()]
    want = decontam.brute_force(DOCS, [i for i in ITEMS if i[0] is not None])
    for w in decontam.brute_force(DOCS, ITEMS):  # an item without an id marks words
        match = next(g for g in got if g[:2] == w[:2])
        assert match[2] == w[2]
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted([(g[0], g[1], *g[3:5]) for g in got], key=key) == sorted([(w[0], w[1], *w[3:5]) for w in want], key=key)


def test_blocks_and_longest(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    one = sorted(map(str, decontam.overlaps(docs, bench).collect()))
    many = sorted(map(str, decontam.overlaps(docs, bench, block_words=5).collect()))
    assert one == many
    report = next(r.report for r in decontam.overlaps(docs, bench).collect() if r.row.doc_id == 1)
    assert (report.longest, report.longest_at) == (12, 1)


def test_removal_and_empty_tables(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {2, 3, 6}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def reports(docs, items, window=10, block=10**6, named=True):
    held = [(str(name) if name is not None else None, decontam.split_words(text)) for name, text in items if text]
    known, get = {}, None
    one = decontam.Items(held, window)
    get = one.vocab.get
    cut = [decontam.np.array([get(w, 0) for w in decontam.split_words(t)], dtype="int64") for t in docs]
    return list(decontam._reports(one, cut, named, known))


def test_random_texts_like_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        words = [chr(97 + k) for k in range(rng.randint(1, 4))]
        text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
        window = rng.randint(1, 5)
        items = [(rng.randint(0, 4), text(14)) for _ in range(rng.randint(0, 5))]
        docs = [(k, text(30)) for k in range(4)] + [(9, " ".join(i[1] for i in items))]
        want = decontam.brute_force(docs, items, window)
        got = reports([t for _, t in docs], items, window)
        for (_, n, hits, n_items, sha, _, longest, at), r in zip(want, got, strict=True):
            covered = sum(e - s for s, e in zip(r["spans"][::2], r["spans"][1::2], strict=True))
            assert (r["n_words"], covered, r["n_items"], r["items_sha256"], r["longest"], r["longest_at"]) == (n, hits, n_items, sha, longest, at), (items, docs)


def test_long_items_in_pieces(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randint(0, 50)}" for _ in range(300))
    docs = [(1, "x " + long + " y"), (2, " ".join(long.split()[40:55])), (3, "w1 w2"), (4, None)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, long), (6, "w1 w2 w3"), (7, long)], "item_id bigint, text string")
    want = {w[0]: w for w in decontam.brute_force(docs, [(5, long), (6, "w1 w2 w3"), (7, long)])}
    for size in (7, 100, 10**6):
        for r in decontam.overlaps(*frames, block_words=size, named=True).collect():
            got = r.report
            w = want[r.row.doc_id]
            assert (got.n_words, sum(got.spans[1::2]) - sum(got.spans[::2]), got.n_items, got.items_sha256) == w[1:5]
            assert got["items"] == (["5", "7"] if w[3] else [])


def test_one_text_of_many_items():
    text = " ".join(f"w{k}" for k in range(40))
    peaks = []
    for n in (500, 4000):
        tracemalloc.start()
        start = time.time()
        got = reports([text] * n, [(k, text) for k in range(n)], named=False)
        assert all((r["n_items"], r["longest"], r["longest_at"]) == (n, 40, 0) for r in got)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert time.time() - start < 60
    assert peaks[1] < 12 * peaks[0]
