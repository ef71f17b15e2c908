"""The stemmer against one written letter by letter, and lemmas."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwell.functions import lists, stems

WORDS = """caresses ponies ties dies cats ss s us used uses feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling
hissing fizzed failing filing happy sky enjoy by say relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli
analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative
formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment
dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll sayyid syzygy yyy tied
tried died lied flies spied news innings succeed proceed skies dying hopefully geologi theologi generalli reliability université naïve 500mg co-trimoxazole don't
doing being ying abilities animals ying y yes eyed keyed buying toying ability aed eed seed oed ion sion tion bion logi ally really""".split()


def consonant(w, i):
    if w[i] in "aeiou":
        return False
    return True if w[i] != "y" or i == 0 else not consonant(w, i - 1)


def measure(w):
    kinds = [consonant(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def vowel(w):
    return any(not consonant(w, i) for i in range(len(w)))


def cvc(w):
    if len(w) == 2:
        return not consonant(w, 0) and consonant(w, 1)
    return len(w) >= 3 and consonant(w, len(w) - 1) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 3) and w[-1] not in "wxy"


def suffix(w, rules, ok):
    for end, new in sorted(rules.items(), key=lambda kv: -len(kv[0])):
        if w.endswith(end):
            left = w[: len(w) - len(end)]
            return left + new if ok(left, end) else w
    return w


def stemmed(w):
    if w in lists.NEGATIONS or len(w) <= 2:
        return w
    if w in lists.STEM_IRREGULAR:
        return lists.STEM_IRREGULAR[w]
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                left = w[: -len(end)]
                if vowel(left):
                    w = left
                    if w[-2:] in ("at", "bl", "iz"):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif measure(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and len(w) > 2 and consonant(w, len(w) - 2):
        w = w[:-1] + "i"
    if w.endswith("alli") and measure(w[:-4]) > 0:
        w = w[:-2]
    w = suffix(w, lists.STEM_DOUBLE, lambda x, e: measure(x + "l" * (e == "logi")) > 0)
    w = suffix(w, lists.STEM_SINGLE, lambda x, e: measure(x) > 0)
    w = suffix(w, lists.STEM_LAST, lambda x, e: measure(x) > 1 and (e != "ion" or x[-1:] in ("s", "t")))
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def test_stems_equal_the_letterwise_stemmer(spark):
    rng = random.Random(4)
    parts = ["ational", "ing", "ed", "s", "y", "yy", "e", "ll", "iz", "bl", "ment", "ion", "ies", "ness", "ful", "b", "a", "o", "st", "w", "ant", "logi", "alli"]
    words = WORDS + list(lists.NEGATIONS) + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in out} == {w: stemmed(w) for w in words}


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("enjoy", "enjoy"), ("not", "not"), ("generalization", "gener"), ("controlled", "control"), ("dies", "die"), ("dying", "die"), ("reliability", "reliabl")])
def test_known_stems(spark, word, stem):
    assert spark.range(1).select(stems.stem(F.lit(word))).first()[0] == stem


def test_lemmas(spark):
    pairs = {"tablets": "tablet", "studies": "study", "boxes": "box", "glasses": "glass", "classes": "class", "women": "woman", "diagnoses": "diagnosis", "virus": "virus", "diabetes": "diabetes", "not": "not", "nothing": "nothing", "leaves": "leaf", "dose": "dose"}
    out = spark.createDataFrame(list(pairs), "string").select("value", stems.lemma(F.col("value")).alias("l")).collect()
    assert {r.value: r.l for r in out} == pairs


def test_lemmas_by_a_dictionary(spark):
    words = spark.createDataFrame([(w,) for w in ["gloves", "wolves", "specimen", "firemen", "glasses", "axes", "axes", "unheard", "cities"]], "word string")
    dictionary = spark.createDataFrame([(w,) for w in ["glove", "wolf", "specimen", "fireman", "glass", "axe", "ax", "city"]], "word string")
    exceptions = spark.createDataFrame([("axes", "axis")], "word string, lemma string")
    want = {"gloves": "glove", "wolves": "wolf", "specimen": "specimen", "firemen": "fireman", "glasses": "glass", "axes": "ax", "unheard": "unheard", "cities": "city"}
    assert {r.word: r.lemma for r in stems.lemma_table(words, dictionary).collect()} == want
    assert {r.word: r.lemma for r in stems.lemma_table(words, dictionary, exceptions).collect()} == want | {"axes": "axis"}
