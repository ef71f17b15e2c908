import re

import pytest
from pyspark.sql import functions as F

from ledgerwell.functions import lists, text


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (89, 1), (90, 1), (91, 2), (155, 2), (156, 3)])
def test_window_counts(spark, n, want):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, text.windows(F.col("t")), t=" ".join(words))
    assert len(got) == want
    if want > 1:
        assert got[0].split()[65:] == got[1].split()[:25]
        assert list(dict.fromkeys(w for g in got for w in g.split())) == words


def test_windows_like_a_loop(spark):
    rows = [(k, " ".join(f"{k}x{i}" for i in range(n))) for k, n in enumerate((0, 5, 12, 13, 14, 37, 100))]
    for size, overlap in ((5, 2), (13, 0), (7, 6)):
        got = {r.k: r.w for r in spark.createDataFrame(rows, "k int, t string").select("k", text.windows(F.col("t"), size, overlap).alias("w")).collect()}
        for k, t in rows:
            w, want, at = t.split(), [], 0
            while w:
                want.append(" ".join(w[at : at + size]))
                if at + size >= len(w):
                    break
                at += size - overlap
            assert got[k] == want
    with pytest.raises(ValueError):
        text.windows(F.col("t"), 5, 5)


def test_cleaning_keeps_negation_and_doses(spark):
    t = "No dose above 500 mg. Do NOT take with the alcohol, see https://x.y/z studies"
    default = one(spark, text.cleaned(F.col("t")), t=t)
    assert {"no", "not", "500"} <= set(default.split()) and "https" not in default
    assert "the" not in default.split()
    harsh = one(spark, text.cleaned(F.col("t"), "aggressive"), t=t)
    assert not {"no", "not", "500"} & set(harsh.split())
    assert one(spark, text.cleaned(F.col("t")), t=None) == ""


def test_identity_and_salient_terms(spark):
    assert one(spark, text.identity_tokens(F.col("t")), t="Metoprolol Succinate and Metoprolol ER") == ["metoprolol"]
    assert one(spark, text.salient_terms(F.col("t")), t="What are the side effects of co-trimoxazole and warfarin and warfarin?") == ["co-trimoxazole", "warfarin"]
    assert one(spark, text.salient_terms(F.col("t")), t=None) == []


def test_redaction_order(spark):
    t = "mail a.b@c.org call +1 555 123 4567 id 123-45-6789 on 2024-01-15 or 1/2/2024 MRN# 77a"
    assert one(spark, text.redact(F.col("t"), lists.REDACTIONS_PHONE_LATE), t=t) == "mail [email] call +[phone] id [id] on [phone] or [date] [record-id]"
    assert one(spark, text.redact(F.col("t")), t=t) == "mail [email] call +[phone] id [phone] on [phone] or [date] [record-id]"


def test_scratchpad_disclaimer_prefix_snippet(spark):
    assert one(spark, text.without_scratchpad(F.col("t")), t="<think>a\nb</think> x ") == "x"
    assert one(spark, text.without_scratchpad(F.col("t")), t=" <think>a</think> ") == "<think>a</think>"
    assert one(spark, text.with_disclaimer(F.col("t"), "D"), t="This is NOT medical advice") == "This is NOT medical advice"
    assert one(spark, text.with_disclaimer(F.col("t"), "D"), t="x") == "x\n\nD"
    assert one(spark, text.without_prefix(F.col("t")), t="Name — field: body: more") == "body: more"
    assert one(spark, text.snippet(F.col("t"), 3), t="abcd") == "abc…"


def test_citations_numbers_overlap(spark):
    assert one(spark, text.citations(F.col("t")), t="[Source 2] [Source  1][Source 2] [Source 99999999999999]") == [1, 2]
    assert one(spark, text.unsupported_numbers(F.col("a"), F.col("c")), a="12.5 and 7 and 3", c="3 x 12.5") == ["7"]
    assert one(spark, text.overlap(F.col("a"), F.col("c")), a="the dose of rings", c="dose") == 0.5
    assert one(spark, text.overlap(F.col("a"), F.col("c")), a="", c="dose") == 0.0


def test_highlight_escapes_first(spark):
    got = one(spark, text.highlight(F.col("t"), "what about metformin doses"), t="<b> Metformin & doses")
    assert got == '&lt;b&gt; <mark class="hl">Metformin</mark> &amp; <mark class="hl">doses</mark>'


def test_screens(spark):
    check = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert check(text.is_red_flag, "sudden  CHEST   pain") and not check(text.is_red_flag, "a pain in the neck")
    assert check(text.is_medication_change, "Should I double my dose?") and not check(text.is_medication_change, "what is it for?")
    assert check(text.is_dosing_imperative, "ok\nTake two") and not check(text.is_dosing_imperative, "the label lists two")
    assert check(text.asks_interaction, "is it safe to take it?") and not check(text.asks_interaction, "what is it?")


def test_fixed_values():
    assert len(lists.INTENT_RULES) == 43 and len(lists.ABBREVIATIONS) == 18
    assert len(set(lists.SALT_WORDS)) == 52 and len(set(lists.PAIR_SALT_WORDS)) == 49
    assert all(re.compile(p) for _, _, p in lists.INTENT_RULES)
    assert len(lists.RED_FLAGS) == 29 and len(lists.OVERLAP_STOP_WORDS) == 23 and len(lists.HIGHLIGHT_STOP_WORDS) == 28


def test_cards(spark):
    snippet = text.card_snippet(F.col("t"), F.lit("A"), F.lit("f"), 10)
    assert one(spark, snippet, t="A — f: short") == "short" and one(spark, snippet, t="B — f: short") == "B — f: sho…"
    assert one(spark, snippet, t="A — f: 12345678  90") == "12345678…"
    assert one(spark, text.citation_label(F.lit("A"), F.lit("f"))) == "A · f"
    from urllib.parse import quote

    for name in ("a b", "é/x", "*~()!'", "a+b&c=d", "100%"):
        assert one(spark, text.link("http://x/?q={}&l=1", F.col("t")), t=name) == f"http://x/?q={quote(name)}&l=1"
