import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import generation, phrases, trace
from ledgerwell.operators.generation import GenerationError, Provider, generate
from ledgerwell.plans import checks
from ledgerwell.sources import labels
from ledgerwell.streaming import audit


def failing(message):
    def call(prompt, model):
        raise GenerationError(message)

    return call


def test_cascade():
    second = Provider("second", ["m"], lambda p, m: p.upper())
    r = generate("x", [Provider("first", ["a", "b"], failing("HTTP 429: rate limit")), second], prefer="first")
    assert (r.text, r.provider, r.fell_back_from, len(r.attempts)) == ("X", "second", "first", 3)
    r = generate("x", [Provider("first", ["a", "b"], failing("429 free-models-per-day quota")), second])
    assert len(r.attempts) == 2 and r.ok
    r = generate("x", [Provider("first", ["a", "b"], failing("401 unauthorized")), Provider("off", ["a"], second.call, lambda: False)])
    assert not r.ok and [a[0] for a in r.attempts] == ["first", "off"]


def test_replies_and_models():
    assert generation.chat_text({"choices": [{"message": {"content": "hi"}}]}, "p") == "hi"
    for bad in ({"error": {"code": 1, "message": "m"}}, {"choices": []}, {"choices": [{"message": {"content": None}, "finish_reason": "length"}]}):
        with pytest.raises(GenerationError):
            generation.chat_text(bad, "p")
    assert generation.choose_model("a:8b", ["b", "a:1b"]) == "a:1b" and generation.choose_model("z", ["b"]) == "b" and generation.choose_model("z", []) is None
    assert generation.label("refused", "red_flag").startswith("emergency") and generation.label("llm", "ok") == "generated"


def test_shapes_of_replies():
    sent = []

    def post(url, payload, headers, timeout):
        sent.append((url, payload, headers))
        return {"chat": {"choices": [{"message": {"content": "a"}}]}, "parts": {"candidates": [{"content": {"parts": [{"text": "b"}]}}]}, "local": {"response": "c"}}[url.split("/")[2]]

    assert [generation.http_call("p", f"http://{shape}/{{model}}", "k", shape, post=post)("hello", "m1") for shape in generation.SHAPES] == ["a", "b", "c"]
    assert sent[0][0] == "http://chat/m1" and sent[0][1]["messages"][0]["content"] == "hello" and sent[0][2]["Authorization"] == "Bearer k"
    assert "hello" in json.dumps(sent[1][1]) and sent[2][1]["model"] == "m1"
    with pytest.raises(GenerationError, match="402 no credit"):
        generation.chat_text({"error": {"code": 402, "message": "no credit"}}, "p")
    assert generation.error_kind("p: 402 no credit") == "account"
    with pytest.raises(GenerationError, match="length"):
        generation.chat_text({"choices": [{"message": {"content": " "}, "finish_reason": "length"}]}, "p")


def test_labels_until_enough_records():
    good = lambda n: {"openfda": {"generic_name": [n]}, "indications_and_usage": ["i"], "mechanism_of_action": ["m"], "adverse_reactions": ["s"]}
    feed = [good("a"), good("A"), {"openfda": {"brand_name": ["x"]}, "indications_and_usage": ["i"]}, {}, good("b"), good("c")]
    fetch = lambda limit, skip: feed[skip : skip + limit]
    assert len(list(labels.pages(fetch, 2, target=2))) == 5 and len(list(labels.pages(fetch, 2, target=9))) == 6


def test_labels(spark):
    item = {"n": {"generic_name": ["co-ALPHA acid"], "route": ["ORAL"]}, "indications_and_usage": ["For  a", "b"], "mechanism_of_action": ["m"], "adverse_reactions": ["s"]}
    fetch = lambda limit, skip: [item, item | {"adverse_reactions": ["later"]}, {"n": {"brand_name": ["Beta"]}, "indications_and_usage": ["x"]}][skip : skip + limit]
    rows = labels.records_from_labels(labels.label_rows(spark, labels.pages(fetch, 2))).collect()
    assert [(r.name, r.category, r.indications, r.description, r.side_effects) for r in rows] == [("Co-Alpha Acid", "Oral", "For a b", "For a b", "s")]


def test_lookup_and_registry(spark):
    names = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string")
    asked = []

    def lookup(name):
        asked.append(name)
        if name == "b":
            raise TimeoutError
        return name.upper()

    assert {r.name: r.standard for r in labels.normalised(names, "name", lookup).collect()} == {"a": "A", "b": None, None: None}
    assert sorted(asked) == ["a", "b"]
    labels.register(labels.PairSource("mine", lambda s: s.range(1)))
    assert labels.pair_source("mine").licence == "unknown"
    with pytest.raises(KeyError):
        labels.pair_source("none")


def test_trace(spark):
    before = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.1)], "query_id bigint, score double")
    rows = trace.step(1, "floor", before, before.where("score > 0.2"), "below floor")
    got = {r.query_id: r for r in rows.withColumn("line", trace.summary()).collect()}
    assert got[1].line == "kept 2 of 2" and got[2].line == "kept 0 of 1, dropped 1 below floor" and got[1].top_scores == [0.5, 0.25]
    assert trace.total_ms([("a", 1.5), ("b", 2)]) == 3.5
    assert {r.reason: r.n for r in trace.drop_totals(rows).collect()} == {"below floor": 1}
    size = spark.range(1).select(trace.context_size(F.lit("[Source 1] a b\n\n[Source 2] c")).alias("s")).first().s
    assert (size.words, size.tokens, size.sources) == (7, 9, 2)


def test_checks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine\nkey = 'gsk_" + "a" * 24 + "'\n")
    assert checks.key_literals(spark, str(tmp_path)).count() == 1
    assert checks.key_literals(spark, str(Path(checks.__file__).parents[1] / "*/*.py")).count() == 0
    assert [checks.exit_code(x) for x in ({"a": "ok"}, {"a": "ok", "b": "degraded"}, {"a": "fail", "b": "degraded"})] == [0, 1, 2]
    assert "config" in checks.quick()


def test_deep_check(spark, tmp_path):
    records = [{"name": "Alphadrin", "category": "x", "description": "Alphadrin is a medicine of much noise, noise and more noise.", "indications": "Alphadrin is used for noise in the ear, noise at night and noise by day."}]
    (tmp_path / "r.json").write_text(json.dumps(records))
    found = checks.deep(spark, str(tmp_path / "r.json"), "alphadrin noise", "zorbax")
    assert found["records"] == "ok" and found["absent"] == "ok" and found["rows"] == "ok"
    (tmp_path / "r.json").write_text("[]")
    assert checks.deep(spark, str(tmp_path / "r.json"), "a", "b")["records"] == "fail"
    assert checks.main([]) in (0, 1)


def test_stream_of_events(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = audit.windowed(audit.read_events(spark, f"{tmp_path}/in/*", batch.schema))
    audit.write_windows(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(str(r.start), r.event_type): (r.n, round(r.total, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    every = {(str(r.w.start), r.event_type): (r.n, round(r.total, 6)) for r in audit.windowed(batch).collect()}
    assert got and all(every[k] == v for k, v in got.items()) and len(got) > 0.9 * len(every)


def test_phrases_in_one_pass_equal_one_test_each(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abé -1") for _ in range(n))
    texts = [(k, make(rng.randrange(0, 300)).upper() if k % 3 else make(80)) for k in range(60)] + [(60, None), (61, "")]
    found = [(k, make(rng.randrange(0, 4))) for k in range(80)] + [(500, "AB"), (501, "ab"), (502, "aa"), (503, None)]
    rows = spark.createDataFrame(texts, "k int, t string")
    table = spark.createDataFrame(found, "phrase_id int, phrase string")
    for block in (1 << 20, 40):  # all in one automaton, and in many passes
        monkeypatch.setattr(phrases, "BLOCK", block)
        for words in (False, True):
            want = set()
            for k, t in texts:
                t = (t or "").lower()
                for number, p in found:
                    p = (p or "").lower()
                    at = [i for i in range(len(t) - len(p) + 1) if p and t[i : i + len(p)] == p and not (words and (t[i - 1 : i].isalnum() or t[i + len(p) : i + len(p) + 1].isalnum()))]
                    if at:
                        want.add((k, number, len(at), at[0]))
            out = phrases.hits(rows, "k", "t", table, words)
            assert {tuple(r) for r in out.collect()} == want and len(want) > 50
