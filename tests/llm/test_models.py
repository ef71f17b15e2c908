import random
import zlib

import numpy as np

from ledgerwell.llm import langid, toxicity
from ledgerwell.llm.toxicity import Kernel

DATA = "/root/testdata/sf0.01"


def held(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_gradients_by_differences():
    model = langid.new_model(["a", "b", "c"], seed=1)
    for ws in (model.table, model.recur, model.out):
        ws[:] = [w.astype(np.float64) for w in ws]
    model.bias = model.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = np.ones((9, 4), np.float32)
    mask[7:, 1] = 0
    _, grads = langid.gradients(model, x, y, mask)
    for w, g in zip(model.weights(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, ends = w[at], []
        for step in (1e-4, -1e-4):
            w[at] = old + step
            ends.append(langid.gradients(model, x, y, mask)[0])
        w[at] = old
        assert abs(g[at] - (ends[0] - ends[1]) / 2e-4) < 1e-4


def test_language_held_out_accuracy_and_edges(spark, save):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    edges = [(90001, None, "en"), (90002, "", "en"), (90003, "12 34 !?", "en"), (90005, "²½ 12 Ⅻ", "en"), (90006, "_ \u0301", "en"), (None, "the of and", None), (90004, "the and of " * 12000, None)]
    out = langid.op8_language(spark, save([(*d, None) for d in docs + edges + docs[:1]])).collect()
    truth = {d: lang for d, _, lang in docs}
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + len(edges) + 1
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 3, 1)) and 0 <= r.score <= 1 for r in out)
    right = [r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (90001, 90002, 90003, 90005, 90006))
    assert by_id[90004].lang_pred == "en"


def test_every_byte_gets_a_language():
    samples = [(b"the cat and the dog " * 6, "en"), ("der Hund und die Katze ".encode() * 6, "de")]
    model = langid.train(samples, rounds=60)
    assert len(langid.labels(model, "the dog é")) == len("the dog é".encode())
    assert langid.train([]) is None


def test_language_sample_is_bounded(spark):
    docs = spark.range(0, 3000, 1, 40).selectExpr("id as doc_id", "concat('text of ', id) as text", "if(id % 3 = 0, 'a', 'b') as lang")
    hot = spark.range(0, 5000, 1, 40).selectExpr("7L as doc_id", "concat('again ', id) as text", "'b' as lang")
    found = langid.training_sample(docs.unionByName(hot), 10)
    assert sorted(lang for _, lang in found) == ["a"] * 10 + ["b"] * 10
    assert found == langid.training_sample(hot.unionByName(docs).repartition(7), 10)
    assert len(langid.training_sample(docs.limit(6), 10)) == 6


def test_language_without_labels(spark, save):
    out = langid.op8_language(spark, save([(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_language_of_empty_table(spark, save):
    assert langid.op8_language(spark, save([])).count() == 0


def test_kernel_like_its_definition():
    words = ["idiot", "idxiot", "i-d-i-o-t", "window", "aaaa", "ab", "", "éclair", "idiots"]

    def features(w):
        w, out = "".join(c for c in w if c.isalnum()), {}
        for i in range(len(w)):
            for a, b in toxicity._STEPS:
                if i + a + b < len(w):
                    key = w[i] + w[i + a] + w[i + a + b]
                    out.setdefault(key, []).append(toxicity.DECAY ** (a + b + 1))
        return out

    def value(x, y):
        fx, fy = ({k: sum(v) for k, v in features(w).items()} for w in (x, y))
        norm = np.sqrt(sum(v * v for v in fx.values()) * sum(v * v for v in fy.values()))
        return (sum(fx[k] * fy[k] for k in fx if k in fy) / norm) ** toxicity.POWER if norm else 0.0

    words += ["hahahaha", "aaaaaa", "éclair éclair", "x" * 300]
    got = Kernel(words).rows(words)
    for i, w in enumerate(words):
        assert np.allclose(got[i], [value(w, t) for t in words], atol=1e-5), w
        assert abs(got[i, i] - (len(w) > 2)) < 1e-5, w
    assert np.linalg.eigvalsh(got.astype(float)).min() > -1e-5
    root = got ** (1 / toxicity.POWER)
    assert root[2, 0] > 0.9999 and 0.5 < root[1, 0] < 0.9


def test_toxicity_on_shipped_labels(spark):
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    out = [r for r in toxicity.op4_toxicity(spark, path).select("doc_id", "held_out", "predicted").collect() if r.held_out and r.doc_id in labels]
    hits = sum(r.predicted and labels[r.doc_id] for r in out)
    recall, precision = hits / sum(labels[r.doc_id] for r in out), hits / sum(r.predicted for r in out)
    print(f"held-out toxicity on sf0.1: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.8 and precision >= 0.9


def test_training_rows_are_bounded(spark):
    docs = [(i, f"text {i}") for i in range(300)] + [(7, f"other {k}") for k in range(500)] + [(None, "x"), (8, None)]
    labels = [(i, i % 2) for i in range(300)] * 2 + [(9, 0), (None, 1), (11, None), (12, 5)]
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    few = toxicity.training_rows(docs, labels, per_label=10)
    assert sum(y for _, y in few) == 10 and len(few) == 20
    everything = toxicity.training_rows(docs, labels, per_label=1000)
    ids = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 and i != 9}
    assert len(everything) == len(ids) and {t for t, _ in everything if t[0] == "t"} <= {f"text {i}" for i in ids}


def test_long_training_texts_count(spark, prose):
    docs = [(prose(9) + ". " + prose(9), 0) for _ in range(60)] + [(". ".join(prose(8) for _ in range(900)) + ". you zorgface you. " * 40, 1) for _ in range(40)]
    model = toxicity.fit(docs)
    scores = model.scores([". ".join(prose(8) for _ in range(5)), prose(30) + ". you zorgface you. " * 3])
    assert scores[0] < 0.5 < scores[1]
    assert len(toxicity.sentences("ww " * 100_000)) == 500


def test_stretched_insults_count_like_plain_ones(prose):
    rng = random.Random(4)
    docs = [(" ".join([*prose(12).split(), *(["idiot"] if k % 2 else []), *prose(12).split()]), k % 2) for k in range(200)]
    model = toxicity.fit(docs)
    said = [f"{prose(9)} {w} {prose(9)}" for w in ("idiot", "idioooot", "IDIOOOOOOT", "iiidiottt", "i d i o t", "w" * rng.randrange(50, 90))]
    assert [s >= 0.5 for s in model.scores(said)] == [True] * 5 + [False]
    assert toxicity.sentences("Aaa bbb. www www 1000 ---- __") == [["a", "b."], ["w", "w", "1000", "----", "__"]]


def test_toxicity_held_out_and_edges(spark, save, prose):
    rng = np.random.default_rng(5)
    bad = ["zorgface", "blutwurm", "grumplug"]
    docs, labels = [], []
    for i in range(1500):
        text, toxic = prose(60).split(), int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(len(text))), bad[int(rng.integers(3))])
        docs.append((i, " ".join(text), None, None))
        labels.append((i, 1, toxic))
    edges = [(9001, None), (9002, ""), (9003, "you zorxgface blutwuurm"), (9004, "z o r g f a c e and g.r.u.m.p.l.u.g"), (9005, prose(40000)), (None, "w1 w2")]
    path = save(docs + [(*e, None, None) for e in edges] + docs[:1])
    spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = toxicity.op4_toxicity(spark, path).collect()
    truth, by_id = {d: t for d, _, t in labels}, {r.doc_id: r for r in out}
    assert len(out) == len(docs) + len(edges) + 1
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and held(r.doc_id, 5, 0)) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]) > 0.97
    assert [by_id[k].predicted for k in (9001, 9002, 9003, 9004, 9005)] == [0, 0, 1, 1, 0]


def test_toxicity_without_labels(spark, save):
    path = save([(1, "x", None, None)])
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert [(r.score, r.predicted) for r in toxicity.op4_toxicity(spark, path).collect()] == [(0.0, 0)]


def test_toxicity_of_empty_table(spark, save):
    path = save([])
    spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert toxicity.op4_toxicity(spark, path).count() == 0
