import difflib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerwell.config import DISCLAIMER, Config, Retrieval, load
from ledgerwell.functions import lists
from ledgerwell.operators import answers, chunking, dense, evaluation, grounding, hybrid, lexical, pairs, routing, shards
from ledgerwell.plans import catalog
from ledgerwell.plans.engine import Engine, health
from ledgerwell.sources import records, uploads

RECORDS = [
    {"name": "Alphadrin Hydrochloride", "category": "Testers", "description": "Alphadrin is a white powder.", "mechanism": "Alphadrin blocks the blue channel and lowers noise.", "indications": "Alphadrin is indicated for loud rooms.", "dosage": "Take 500 mg twice daily.", "side_effects": "Silence, dizziness, rash.", "contraindications": "Do not use with Betazol.", "interactions": "Betazol raises its level.", "source": "x"},
    {"name": "Betazol", "category": "", "description": "Betazol is a gel.", "mechanism": "", "indications": "For quiet rooms.", "dosage": None, "side_effects": "Noise, headache.", "contraindications": "", "interactions": "Alphadrin.", "source": "x"},
    {"name": "Gammol and Deltin", "category": "Mix", "description": "A mix.", "side_effects": "Dizziness and noise.", "source": "x"},
    {"name": " ", "category": "Testers", "description": "No name."},
]
BRANDS = [("loudex", "alphadrin", "resolve"), ("mixor", "deltin", "combination"), ("gone", "omegon", "absent")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("r") / "records.json"
    path.write_text(json.dumps(RECORDS))
    return chunking.documents_from_records(records.read_records(spark, str(path)))


def test_records(spark, corpus, tmp_path):
    got = {(r.doc_id, r.category) for r in corpus.collect()}
    assert ("alphadrin hydrochloride::dosage", "Testers") in got and ("betazol::description", "uncategorized") in got
    assert len(got) == 7 + 4 + 2
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        records.write_records(corpus.limit(0), str(tmp_path / "out"))


def test_numbering_is_dense(spark, corpus):
    rows = chunking.numbered(chunking.chunk_table(corpus)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert [(r.doc_id, r.win) for r in rows] == sorted((r.doc_id, r.win) for r in rows)


def test_bm25_like_a_loop(spark):
    rng = random.Random(3)
    docs = {k: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for k in range(40)}
    asked = {1: list("aab"), 2: list("hz"), 3: []}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "chunk_id long, clean string")
    q = spark.createDataFrame([(k, " ".join(w)) for k, w in asked.items()], "query_id long, clean string")
    got = {(r.query_id, r.chunk_id): r.bm25 for r in lexical.bm25(lexical.build_index(d), q).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for w in docs.values() for t in set(w))
    want = {}
    for qk, terms in asked.items():
        for dk, w in docs.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in terms if t in w)
            if s:
                want[qk, dk] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dense_topk_and_cells(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in dense.batch_topk(v.repartition(5), q, 4).collect()}
    for i in range(0, 300, 60):
        assert [got[i, r] for r in range(1, 5)] == np.argsort(-np.round(x @ x[i], 9), kind="stable")[:4].tolist()
    cells = dense.cell_topk(v, q, 4, probes=17)
    assert {(r.query_id, r["rank"]): r.vec_id for r in cells.collect()} == got
    assert dense.norm_error(v).first().worst < 1e-9
    with pytest.raises(ValueError):
        dense.require_unit(v.withColumn("embedding", F.transform("embedding", lambda e: e * 2)))
    assert dense.aligned(v, v, "vec_id") and not dense.aligned(v, v.limit(3), "vec_id")
    assert dense.batch_topk(v, q.limit(0), 3).count() == 0


def test_cells_by_the_registered_query(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 32))
    x[1500:] = x[0] + 0.01 * rng.normal(size=(500, 32))  # one crowded place
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    queries = __spark_entry__.queries()
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        got, want = ({(r.query_id, r.vec_id) for r in queries[name](spark, folder).collect()} for name in ("ivf_topk", "vector_batch_topk"))
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_verbatim_matches_of_short_items(spark, tmp_path):
    docs = [(1, "see one two three four five, and six"), (2, "x one two  three fourth five"), (3, "zone two three"), (4, "one\ntwo three"), (5, "solo"), (6, ""), (7, None), (8, "a b c d e f g h")]
    items = ["one two three four five", "one two three four", "one two three", "one two", "one", "", None, "b c d e f g", "solo", "two  three", "no such thing here at all"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    schema = "item_id long, text string"
    for rows in (list(enumerate(items)), [(0, items[0])], []):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        got = {(r.query_id, r.chunk_id) for r in catalog._truth(spark, str(tmp_path)).collect()}
        assert got == {(i, d) for i, item in rows for d, text in docs if item is not None and text is not None and item in text}


def test_grounding_ladder(spark):
    vocab = spark.createDataFrame([("alphadrin",), ("betazol",), ("deltin",)], "token string")
    brands = spark.createDataFrame(BRANDS, "brand string, generic string, kind string")
    asked = spark.createDataFrame([(1, "Does Loudex mix with betazol?"), (2, "mixor dose"), (3, "what is the dose"), (4, "xylophon")], "query_id long, query string")
    rows = grounding.ground(asked, vocab, brands)
    out = {r.query_id: r for r in grounding.outcomes(asked, rows).collect()}
    assert out[1].rewritten == "Does alphadrin mix with betazol?" and out[1].aliases == {"loudex": "alphadrin"} and "mix" in out[1].unknown
    assert out[2].matched == [] and out[2].unknown == ["mixor"] and out[2].notes == {"mixor": "deltin: combination"}
    assert out[3].unknown == [] and out[4].unknown == ["xylophon"]
    st = {r.query_id: r.status for r in hybrid.statuses(grounding.outcomes(asked, rows), asked.limit(0)).collect()}
    assert st == {1: "no_relevant_context", 2: "unknown_entity", 3: "no_entity", 4: "unknown_entity"}
    near = {r.term: r.match for r in grounding.suggestions(spark.createDataFrame([("alfadrin",), ("betasol",), ("zzz",)], "term string"), vocab).collect()}
    assert near == {t: difflib.get_close_matches(t, ["alphadrin", "betazol", "deltin"], 1, 0.82)[0] for t in ("alfadrin", "betasol")}


def test_minmax_flat_and_absent(spark):
    chunks = spark.createDataFrame([(i,) for i in range(3)], "chunk_id long")
    bm = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0)], "query_id long, chunk_id long, bm25 double")
    de = spark.createDataFrame([(1, i, 0.5) for i in range(3)], "query_id long, chunk_id long, dense double")
    got = {r.chunk_id: r.score for r in hybrid.blend(bm, de, chunks, 0.2).collect()}
    assert got == pytest.approx({0: 0.2 * 0.5 + 0.4, 1: 0.2 + 0.4, 2: 0.4})


def test_floor_is_on_raw_scores_and_cascade_cuts_first(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 0.1, 0.9), (1, 2, 0.99, 0.25, 0.5), (1, 3, 0.0, 0.2, 0.99)], "query_id long, chunk_id long, bm25 double, dense double, score double")
    assert [r.chunk_id for r in hybrid.ranked(rows, 5).orderBy("rank").collect()] == [1, 2]
    assert [r.chunk_id for r in hybrid.reranked(rows, 5, F.col("dense"), pool=2).orderBy("rank").collect()] == [1]


def test_restrict_falls_back(spark):
    rows = spark.createDataFrame([(q, c, 1.0) for q in (1, 2) for c in (1, 2)], "query_id long, chunk_id long, score double")
    tokens = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, token string")
    wanted = spark.createDataFrame([(1, "a"), (2, "zz")], "query_id long, token string")
    got = sorted((r.query_id, r.chunk_id) for r in hybrid.restrict(rows, wanted, tokens).collect())
    assert got == [(1, 1), (2, 1), (2, 2)]


def test_intents_like_a_loop(spark):
    import re

    asked = ["how does it work", "side effects of x and how much", "nothing here", "can I take with food during pregnancy", ""]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {r.query_id: r.x for r in df.select("query_id", routing.intents(F.col("query")).alias("x")).collect()}
    for k, q in enumerate(asked):
        raw = Counter()
        for intent, w, p in lists.INTENT_RULES:
            if re.search(p, q, re.I):
                raw[intent] += w
        assert got[k] == pytest.approx({i: w / sum(raw.values()) for i, w in raw.items()}, abs=1e-4)


def test_persona_policy(spark):
    rows = [(1, 1, "mechanism", "drug-corpus", 9.0), (1, 2, "indications", "drug-corpus", 8.0), (1, 3, "contraindications", "drug-corpus", 7.0), (1, 4, "page 1", "upload:f", 6.0), (1, 5, "description", "drug-corpus", 5.0), (1, 6, "side_effects", "drug-corpus", 4.0)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, field string, origin string, score double")
    got = [r.chunk_id for r in routing.select_for(routing.PATIENT, df).orderBy("position").collect()]
    assert got == [3, 5, 2, 4]
    assert routing.PATIENT.fetch_k() == 20 and routing.PRACTITIONER.fetch_k() == 8 and routing.PATIENT.fetch_k(50) == 60
    assert "k" in routing.PATIENT.diff(routing.PRACTITIONER)


def test_packing_keeps_whole_blocks(spark):
    rows = [(1, r, "d", "f", 0.5, "x" * n) for r, n in enumerate((500, 100, 10), 1)]
    df = spark.createDataFrame(rows, "query_id long, rank int, drug string, field string, score double, text string")
    assert answers.packed(df, 300).first().n_sources == 1
    assert answers.packed(df, 690).first().n_sources == 2
    assert answers.packed(df).first().context.startswith("[Source 1] (drug=d, field=f, score=0.500)\nxxx")


def test_enforcement(spark):
    df = spark.createDataFrame([("Take two. Indication: none",)], "t string")
    plain, headed = df.select(answers.enforce_plain(F.col("t")).alias("p"), answers.enforce_headings(F.col("t")).alias("h")).first()
    assert answers.ADVISORY in plain and "doctor or pharmacist" in plain
    assert "Dosing" in headed and answers.MISSING in headed


def test_pairs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,a,j,b,l\n1,Alpha,2,Beta,Minor\n2,Beta,1,alpha,Major\n3,Gamma Sodium,4,Delta,odd\n5,Same,5,Same,Major\n6,,7,Beta,Major\n")
    (tmp_path / "b.csv").write_text("i,a,j,b,l\n1,Alpha,3,Gamma Sodium,Moderate\n")
    raw = pairs.read_pairs(spark, str(tmp_path))
    table = pairs.severest(raw)
    assert {(r.a, r.b): r.level for r in table.collect()} == {("alpha", "beta"): "Major", ("delta", "gamma sodium"): "Unknown", ("alpha", "gamma sodium"): "Moderate"}
    known = pairs.names(raw)
    assert {r.name: r.display for r in known.collect()}["alpha"] == "Alpha"
    items = spark.createDataFrame([(1, 1, "ALPHA"), (1, 2, "gamma"), (1, 3, "beta"), (1, 4, "beta"), (1, 5, "nobody"), (2, 1, "delta"), (2, 2, "beta")], "list_id int, pos int, input string")
    resolved = pairs.resolve(items, known)
    found, summary = pairs.check_lists(items, resolved, table)
    assert [r.level for r in found.where("list_id = 1").orderBy("place").collect()] == ["Major", "Major", "Moderate"]
    rows = {r.list_id: r for r in pairs.summary_text(summary).collect()}
    assert (rows[1].major, rows[1].moderate, rows[1].safe_pairs, rows[1].unresolved) == (2, 1, 2, ["nobody"])
    assert rows[2].safe_pairs == 1 and rows[2].message.startswith("No documented interactions")
    assert spark.range(1).select(pairs.split_list(F.lit("a, b;\n;c")).alias("x")).first().x == ["a", "b", "c"]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "query_id int, chunk_id int")
    results = spark.createDataFrame([(1, 5, 1), (2, 9, 1), (2, 6, 2)], "query_id int, chunk_id int, rank int")
    r = evaluation.recall_mrr(cases, results, ["query_id", "chunk_id"], 1).first()
    assert (r.cases, r.recall, r.mrr) == (3, pytest.approx(1 / 3), pytest.approx(0.5))


def test_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n## One \ntext  one\n# Two\nx")
    (tmp_path / "b.csv").write_text("n,m\nx,1\n,\ny,2\n")
    (tmp_path / "c.json").write_text('[{"a": 1, "b": true, "c": "", "d": [1]}, "s"]')
    (tmp_path / "d.txt").write_text("z" * 50 + " tail")
    got = {r.doc_id: r for r in uploads.documents(spark, str(tmp_path), budget=52).collect()}
    assert got["b.csv::row 1"].text == "n: x | m: 1" and "b.csv::row 2" not in got and got["b.csv::row 3"].origin == "upload:b.csv"
    assert got["c.json::record 1"].text == "a: 1 | b: True" and got["c.json::record 2"].text == "s"
    assert {k for k in got if k.startswith("a.md")} == {"a.md::intro", "a.md::One", "a.md::Two"}
    assert got["d.txt::body"].text == "z" * 50 + " t"
    with pytest.raises(ValueError):
        uploads.sections("x.exe", b"")


def test_upload_kinds(spark, tmp_path):
    """Quoted cells, the order of members, scalars, headings and files that can't be used."""
    import zipfile

    (tmp_path / "t.csv").write_text('n,m,o\n"a, b","x ""q""\ny",\n\n,,\n1, ,2\n')
    (tmp_path / "o.json").write_text('{"z": "", "a": 1.5, "m": null, "k": {"x": 1}, "b": false, "l": [1]}')
    (tmp_path / "l.json").write_text('[{"z": 2, "a": "x"}, {"e": " "}, null, 3, true, "t"]')
    (tmp_path / "s.json").write_text('"only"')
    (tmp_path / "h.md").write_text("# Only heading\nbody of it")
    (tmp_path / "m.markdown").write_text("\n## \ntext\n### " + "x" * 70 + "\nmore\n#no heading")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<d xmlns:w="{ns}"><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></d>')
    got = {r.doc_id: r.text for r in uploads.documents(spark, str(tmp_path)).collect()}
    assert got == {
        "t.csv::row 1": 'n: a, b | m: x "q" y', "t.csv::row 3": "n: 1 | m: | o: 2", "o.json::body": "z: | a: 1.5 | b: False",
        "l.json::record 1": "z: 2 | a: x", "l.json::record 3": "None", "l.json::record 4": "3", "l.json::record 5": "True", "l.json::record 6": "t",
        "s.json::body": "only", "h.md::body": "# Only heading body of it", "m.markdown::section": "## text", "m.markdown::" + "x" * 60: "### " + "x" * 70 + " more #no heading", "w.docx::body": "one two three",
    }
    (tmp_path / "blank.txt").write_text(" \n ")
    with pytest.raises(ValueError, match="blank.txt"):
        uploads.documents(spark, str(tmp_path))
    (tmp_path / "x.exe").write_text("?")
    with pytest.raises(ValueError, match="x.exe"):
        uploads.documents(spark, str(tmp_path))
    assert uploads.documents(spark, str(tmp_path), strict=False).count() == len(got)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"retrieval": {"alpha": 7, "nope": 1, "top_k": "x"}, "answering": {"disclaimer": " "}, "other": {}}')
    c = load(path)
    assert c.retrieval.alpha == 1.0 and c.retrieval.top_k == 5 and c.answering.disclaimer == DISCLAIMER and len(c.warnings) == 5
    path.write_text("{{{")
    assert load(path).warnings and load(tmp_path / "none").warnings == []


def test_engine_end_to_end(spark, corpus):
    brands = spark.createDataFrame(BRANDS, "brand string, generic string, kind string")
    upload = spark.createDataFrame([("p.md::Zeta", "p", "Zeta", "upload", "Zetarin protocol needs 42 drops", "upload:p.md", {"a": "b"})], corpus.schema)
    asked = spark.createDataFrame([(1, "What are the side effects of Loudex?"), (2, "side effects of zorbax"), (3, "tell me the dose"), (4, "I have chest pain"), (5, "should I double alphadrin?")], "query_id long, query string")
    low = Config(retrieval=Retrieval(bm25_floor=0.3))  # a handful of chunks makes small scores
    engine = Engine(corpus, brands, dense.hashing_encoder(), config=low)
    out = {r.query_id: r for r in engine.answer(asked, routing.PATIENT).collect()}
    assert out[1].status == "ok" and out[1].aliases == {"loudex": "alphadrin"} and out[1].verification.grounded and "Silence" in out[1].answer
    assert (out[2].status, out[3].status, out[4].status, out[5].status) == ("unknown_entity", "no_entity", "red_flag", "medication_change")
    assert "zorbax" in out[2].answer and out[2].context is None
    said = {r.query_id: r for r in Engine(corpus, brands, None, lambda p: "<think>x</think>All fine [Source 9]", low).answer(asked.where("query_id = 1")).collect()}
    assert said[1].mode == "llm" and said[1].verification.invalid == [9] and not said[1].verification.grounded
    assert health(engine, "alphadrin noise", "zorbax") == {"known": "ok", "absent": "ok", "dense": "ok", "rows": "ok"}
    with_upload = Engine(corpus.unionByName(upload), brands, dense.hashing_encoder(), config=low)
    results, outcomes = with_upload.retrieve(spark.createDataFrame([(1, "how many drops does the zetarin protocol need")], "query_id long, query string"))
    assert outcomes.first().status == "ok" and "42 drops" in {r["rank"]: r.text for r in results.collect()}[1]


def test_vector_cache(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, 0.5])], "chunk_id long, embedding array<double>")
    records.write_vectors(v, str(tmp_path / "v"), "f", "m")
    assert records.cached_vectors(spark, str(tmp_path / "v"), "f", 1).count() == 1
    assert records.cached_vectors(spark, str(tmp_path / "v"), "g", 1) is None and records.cached_vectors(spark, str(tmp_path / "none"), "f", 1) is None
    assert records.read_brands(spark, str(tmp_path / "none.json")).count() == 0


def test_engine_grows_is_kept_and_tells(spark, corpus, tmp_path):
    brands = spark.createDataFrame(BRANDS, "brand string, generic string, kind string")
    low = Config(retrieval=Retrieval(bm25_floor=0.3))
    calls = []

    def encoder(texts):
        calls.append(len(texts))
        return dense.hashing_encoder()(texts)

    engine = Engine(corpus, brands, dense.hashing_encoder(), config=low, store=f"file://{tmp_path}/kept")
    again = Engine(corpus, brands, dense.hashing_encoder(), config=low, store=f"file://{tmp_path}/kept")
    assert again.vectors.inputFiles() == engine.vectors.inputFiles() and sorted(map(str, again.chunks.collect())) == sorted(map(str, engine.chunks.collect()))
    upload = spark.createDataFrame([("p.md::Zeta", "p", "Zeta", "upload", "Zetarin protocol needs 42 drops", "upload:p.md", {"a": "b"})], corpus.schema)
    more = engine.extended(upload)
    full = Engine(corpus.unionByName(upload), brands, dense.hashing_encoder(), config=low)
    n = engine.chunks.count()
    assert {r.chunk_id for r in more.chunks.collect()} == set(range(n + 1)) and more.chunks.where(f"chunk_id = {n}").first().origin == "upload:p.md"
    key = lambda e, rows: sorted((r.query_id, r.text, round(r.score, 9), r["rank"]) for r in rows.collect())
    asked = spark.createDataFrame([(1, "how many drops does the zetarin protocol need"), (2, "side effects of alphadrin")], "query_id long, query string")
    assert key(more, more.retrieve(asked)[0]) == key(full, full.retrieve(asked)[0])
    assert {r.term: r.df for r in more.index.frequencies.collect()} == {r.term: r.df for r in full.index.frequencies.collect()}
    assert [name for name, _ in more.steps][-1] == "results" and all(ms > 0 for _, ms in more.steps)
    rows = {(r.query_id, r.name): r for r in more.trace.collect()}
    assert rows[1, "floor"].rows_in >= rows[1, "floor"].rows_out == rows[1, "cut"].rows_in
    said = {r.query_id: r for r in engine.answer(spark.createDataFrame([(1, "dose of alphadrn"), (2, "what is mixor")], "query_id long, query string")).collect()}
    assert "alphadrn → alphadrin" in said[1].answer and "**Mixor** is a name of *deltin*" in said[2].answer
    with pytest.raises(ValueError):
        dense.require_aligned(engine.chunks, engine.vectors.limit(1))


def test_pairs_blend_like_all(spark):
    """Scores of chosen pairs are those of the whole table of chunks by queries."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(3)], "query_id long, embedding array<double>")
    bm = spark.createDataFrame([(i % 3, i, float(i + 1)) for i in range(0, 40, 4)], "query_id long, chunk_id long, bm25 double")
    every = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("query_id", "chunk_id", dense.cosine(F.col("embedding"), F.col("q")).alias("dense"))
    whole = {(r.query_id, r.chunk_id): r for r in hybrid.blend(bm, every, v, 0.3).collect()}
    some = every.where("chunk_id % 5 = query_id").select("query_id", "chunk_id")
    got = hybrid.blend_pairs(some, bm, v, q.withColumnRenamed("embedding", "q"), dense.bounds(v, q), v, 0.3).collect()
    assert len(got) == 24 and all(abs(r.score - whole[r.query_id, r.chunk_id].score) < 1e-9 and r.bm25 == whole[r.query_id, r.chunk_id].bm25 for r in got)
    lab = {(r.alpha, r.query_id, r["rank"]): r.chunk_id for r in hybrid.lab(hybrid.scale(bm, every, v), (0.0, 0.3), 4, floor=False).collect()}
    for i in range(3):
        best = sorted((k for k in whole if k[0] == i), key=lambda k: (-round(whole[k].score, 9), k[1]))[:4]
        assert [lab[0.3, i, r] for r in range(1, 5)] == [c for _, c in best]


def test_cells_are_kept(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 90 = 0").withColumnRenamed("vec_id", "query_id")
    path = f"file://{tmp_path}/index"
    dense.write_cells(v, path)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(dense.cell_topk(dense.read_cells(spark, path), q, 3, 2)) == key(dense.batch_topk(v, q, 3)) == key(dense.search(v, q, 3, path, True))
    assert [dense.wants_cells(*a) for a in ((10**6,), (49_999,), (10**6, False), (319, True), (320, True))] == [True, False, False, False, True]


def test_persona_and_pair_measures(spark):
    rows = [("ok", True, "dosage", 2, 100, 10.0, False), ("ok", False, "mechanism", None, 300, 20.0, False), ("red_flag", False, "dosage", None, None, 30.0, False), ("unknown_entity", False, "dosage", None, None, 40.0, False), ("ok", True, None, None, 200, 50.0, False), ("no_entity", False, None, None, None, 1.0, True), ("ok", False, None, None, 5, 1.0, True)]
    cases = spark.createDataFrame(rows, "status string, drug_hit boolean, field string, first_rank int, context_chars int, ms double, must_refuse boolean")
    r = evaluation.persona_metrics(cases, frozenset({"dosage"}), frozenset({"mechanism"})).first()
    assert (r.answered, r.in_policy, r.out_of_policy, r.policy_refusals, r.retrieval_misses) == (3, 1, 2, 1, 1)
    assert (r.drug_recall, r.field_recall, r.field_mrr, r.refusal_accuracy, r.mean_context_chars, r.mean_ms) == (pytest.approx(2 / 3), 1.0, 0.5, 0.5, 200.0, 30.0)
    assert evaluation.persona_metrics(cases.limit(0), None).first().field_recall is None
    pairs_ = spark.createDataFrame([("Major", None, "ok", "Major"), ("Major", None, "ok", "Minor"), (None, "same_drug", "same_drug", None)], "want_level string, want_status string, status string, level string")
    assert evaluation.pair_accuracy(pairs_).first().interaction_accuracy == pytest.approx(2 / 3)


def test_lists_of_few_names(spark):
    items, short = pairs.list_items(spark.createDataFrame([(1, "a, b;\nc"), (2, "only"), (3, " ,;"), (4, None)], "list_id int, text string"))
    assert sorted((r.list_id, r.pos, r.input) for r in items.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    assert {r.list_id: r.status for r in short.collect()} == {2: "too_few", 3: "too_few"}


def test_vectors_by_fingerprint_and_brand_maps(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a b"), (2, "c")], "chunk_id long, text string")
    encoder, path = dense.hashing_encoder(8), f"file://{tmp_path}/v"
    first, how = records.embedded(chunks, encoder, path, "m")
    assert not how["cached"] and first.count() == 2
    assert records.embedded(chunks, encoder, path, "m")[1]["cached"] and not records.embedded(chunks.limit(1), encoder, path, "m")[1]["cached"]
    assert records.embedded(chunks, encoder, path, "m", use_dense=False) == (None, {"disabled": True, "cached": False})
    brands = spark.createDataFrame([("x", "g", "G", "resolve"), ("y", "h i", None, "combination"), ("z", "k", None, "absent")], "brand string, generic string, record string, kind string")
    at = f"file://{tmp_path}/brands"
    assert records.regenerate_brands(brands, at) == 0 and records.regenerate_brands(brands, at, check=True) == 0
    assert records.regenerate_brands(brands.where("brand <> 'z'"), at, check=True) == 1


def test_audit_log(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "p", "call 555 123 4567 89", "ok", "llm", 2, (["1"], 2, 0.5, True), ["f"], "T·f")], "time string, persona string, query string, status string, mode string, n_sources int, verification struct<citations:array<string>,n_sources:int,overlap:double,grounded:boolean>, dropped_fields array<string>, source_ids string")
    log, out = f"file://{tmp_path}/log", f"{tmp_path}/csv"
    for _ in range(2):
        answers.append_audit(answers.audit_rows(rows), log)
    answers.export_audit(spark, log, out)
    got = spark.read.csv(out, header=True).collect()
    assert len(got) == 2 and (got[0].query, got[0].cited, got[0].source_ids, got[0].provider, got[0].withheld_fields) == ("call [phone]", "1/2", "T·f", "—", "f")


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(8)
    make = lambda n: {"".join(rng.choice("abcdeinorst-") for _ in range(rng.randrange(3, 14))) for _ in range(n)}
    known = make(1500) | {"aaaaaaaa", "abababab", "a" * 400}
    asked = make(200) | {"aaaaaaa", "babababa", "a" * 330 + "b"}
    for w in list(known)[:400]:
        k = rng.randrange(len(w))
        asked.add((w[:k] + rng.choice(["", "x", "st"]) + w[k + rng.randrange(2) :]) or "x")
    for cutoff in (0.82, 0.7):
        want = {}
        for x in asked:
            best = max(((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in known if 2 * min(len(x), len(y)) >= cutoff * (len(x) + len(y))), default=(0.0, ""))
            if best[0] >= cutoff:
                want[x] = (best[1], best[0])
        frames = spark.createDataFrame([(x,) for x in asked], "term string"), spark.createDataFrame([(y,) for y in known], "token string")
        out = grounding.suggestions(*frames, cutoff).collect()
        assert {r.term: (r.match, r.ratio) for r in out} == want and len(want) > 200
    assert grounding.candidates(*frames, 0.82).count() < len(asked) * len(known) / 20
    with pytest.raises(ValueError):
        grounding.suggestions(*frames, 0.6)


@pytest.mark.parametrize(("documents", "queries", "idf"), [(50, 7, "plus1"), (16_384, 4096, "plus1"), (90, 4096, "okapi")])
def test_packed_shards_give_the_best_of_all_scores(spark, monkeypatch, documents, queries, idf):
    rng = random.Random(documents)
    words = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 200])))) for i in range(400)] + [(1000 + i, "w1 w2 w2") for i in range(12)]
    asked = [(q, " ".join(rng.choice(words + ["unheard"]) for _ in range(rng.choice([0, 1, 2, 30])))) for q in range(40)]
    index = lexical.build_index(spark.createDataFrame(rows, "chunk_id bigint, clean string"))
    wanted = spark.createDataFrame(asked, "query_id bigint, clean string")
    monkeypatch.setattr(shards, "QUERIES", queries)
    shown = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.bm25, 8)) for r in df.collect())
    want = shown(lexical.top(lexical.bm25(index, wanted, idf=idf), 5, "bm25"))
    assert len(want) > 100
    for terms in (None, lexical.terms_of(wanted, "query_id", "clean")):
        assert shown(shards.best(shards.packed(index, idf=idf, terms=terms, documents=documents), wanted, 5)) == want


def test_shards_stop_early():
    """Completing only what can still get among the best gives the same documents as adding everything."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(5, 400)), 5
        terms = []
        for _ in range(rng.integers(1, 20)):
            at = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            parts = rng.random(len(at)) * 2.5
            terms.append((float(rng.exponential()), at, parts, float(parts.max())))
        full = np.zeros(n)
        for w, at, parts, _ in terms:
            full[at] += w * parts
        some, score = shards._scores(terms, n, k)
        assert np.allclose(score, full[some]) and set(np.argsort(-full)[:k]) & set(np.flatnonzero(full)) <= set(some)


@pytest.mark.parametrize(("alpha", "encoder"), [(0.2, True), (1.0, True), (0.2, False)])
def test_uploads_are_ranked_as_if_all_were_scored(spark, corpus, monkeypatch, alpha, encoder):
    rng = random.Random(3)
    words = "drops noise rash dose protocol zeta blue channel take daily".split()
    fields = [*lists.RECORD_FIELDS, "page 1", "page 2", "row 3"]
    uploads_ = [(f"u{i}", "u", rng.choice(fields), "upload", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), "upload:u", {"a": "b"}) for i in range(70)]
    settings = Config(retrieval=Retrieval(bm25_floor=0.3, emb_floor=0.1, alpha=alpha))
    engine = Engine(corpus.unionByName(spark.createDataFrame(uploads_, corpus.schema)), None, dense.hashing_encoder() if encoder else None, config=settings)
    asked = spark.createDataFrame([(1, "noise of the blue channel"), (2, "what is the dose of alphadrin"), (3, "unheard words only"), (4, "side effects of zeta drops")], "query_id long, query string")
    shown = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in engine.retrieve(asked, k=3)[0].collect())
    got = shown()

    def every(self, asked, grounded, *rest):
        matched = grounded.where("entity is not null").select("query_id", F.col("entity").alias("token")).distinct()
        held = grounding.chunk_tokens(self.chunks).join(matched, "token").select("query_id", "chunk_id")
        return held.unionByName(asked.select("query_id").crossJoin(self.uploads.select("chunk_id"))).distinct()

    monkeypatch.setattr(Engine, "_allowed", every)
    assert got == shown() and len(got) > 5


def test_an_addition_writes_only_its_own_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr("ledgerwell.plans.engine.PARTS", 3)
    low = Config(retrieval=Retrieval(bm25_floor=0.3))
    engine = Engine(corpus, None, dense.hashing_encoder(), config=low)
    one = lambda k: spark.createDataFrame([(f"n{k}", f"Newmed{k}", "dosage", "x", f"Newmed{k} needs {k} drops", chunking.CORPUS if k % 2 else "upload:n", {"a": "b"})], corpus.schema)
    grown, files = engine, lambda e: set(e.chunks.inputFiles()) | set(e.index.postings.inputFiles()) | set(e.vectors.inputFiles()) | set(e.frequencies.inputFiles())
    for k in range(1, 5):
        before, grown = files(grown), grown.extended(one(k))
        if k % 3:
            new = files(grown) - before
            assert before <= files(grown) and spark.read.parquet(*[f for f in new if "chunks" in f]).count() == 1
            assert spark.read.parquet(*[f for f in new if "vectors" in f]).count() == 1
        else:
            assert not before & files(grown)  # written together
    whole = corpus
    for k in range(1, 5):
        whole = whole.unionByName(one(k))
    full = Engine(whole, None, dense.hashing_encoder(), config=low)
    asked = spark.createDataFrame([(1, "how many drops of newmed3"), (2, "side effects of alphadrin"), (3, "newmed2 drops")], "query_id long, query string")
    shown = lambda e: sorted((r.query_id, r["rank"], r.text, round(r.score, 9)) for r in e.retrieve(asked)[0].collect())
    assert shown(grown) == shown(full) and {r.token for r in grown.vocabulary.collect()} == {r.token for r in full.vocabulary.collect()}
    assert {r.term: r.df for r in grown.index.frequencies.collect()} == {r.term: r.df for r in full.index.frequencies.collect()}


def test_steps_count_their_rows_as_they_pass(spark, corpus):
    engine = Engine(corpus, None, dense.hashing_encoder(), config=Config(retrieval=Retrieval(bm25_floor=0.3)))
    asked = spark.createDataFrame([(1, "side effects of alphadrin"), (2, "dose of alphadrin"), (3, "nothing known")], "query_id long, query string")
    results, _ = engine.retrieve(asked, k=2)
    assert engine.rows["results"] == results.count() > 0 and engine.rows["outcomes"] == 3 and engine.rows["queries"] == 2
    assert [name for name, _ in engine.steps] == list(engine.rows) and engine.rows["scores"] == engine.trace.where("name = 'floor'").agg(F.sum("rows_in")).first()[0]


def test_generators_are_called_side_by_side(spark, corpus):
    import threading
    import time

    running, most, lock = set(), [0], threading.Lock()

    def generate(prompt):
        with lock:
            running.add(threading.get_ident())
            most[0] = max(most[0], len(running))
        time.sleep(0.05)
        with lock:
            running.discard(threading.get_ident())
        if "dose" in prompt.rpartition("QUESTION")[2]:
            raise OSError("no answer")
        return "Fine [Source 1]"

    engine = Engine(corpus, None, None, generate, Config(retrieval=Retrieval(bm25_floor=0.3)))
    asked = spark.createDataFrame([(k, "side effects of alphadrin" if k % 3 else "dose of alphadrin") for k in range(30)], "query_id long, query string")
    modes = {r.query_id: r.mode for r in engine.answer(asked).select("query_id", "mode").collect()}
    assert most[0] > 1 and {k for k, m in modes.items() if m == "llm"} >= {k for k in range(30) if k % 3} and len(modes) == 30
