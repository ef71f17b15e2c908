"""Stems and lemmas of English words as column expressions.

The stemmer strips suffixes in steps. A step tells what is left of a word by its shape, a string of c and v for its consonants
and vowels; the measure of a shape is how often a vowel is followed by a consonant in it. A step's branch is only computed for
words with one of its endings. Lemmas are singulars of nouns: irregular ones from a table, regular ones by their ending, or,
where a dictionary is at hand, whichever candidate it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwell.functions import lists


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def shape(word: Column) -> Column:
    """c and v for each letter: y is a vowel after a consonant; what is no letter counts as a consonant."""
    plain = F.regexp_replace(F.regexp_replace(word, "[^aeiouy]", "c"), "[aeiou]", "v")
    first = F.regexp_replace(plain, "(^|v)y", "$1c")
    return F.when(F.contains(word, F.lit("y")), F.regexp_replace(F.regexp_replace(first, "yy", "vc"), "y", "v")).otherwise(plain)


def measured(word: Column, least: int) -> Column:
    """Whether the measure of a word is at least so much."""
    return shape(word).rlike(".*".join(["vc"] * least))


def _closed(word: Column) -> Column:
    """Whether a word ends in consonant, vowel, consonant (not w, x, y), or is a vowel and a consonant."""
    end = F.right(shape(word), F.lit(3))
    return F.when(F.length(word) == 2, end == "vc").otherwise((end == "cvc") & ~word.rlike("[wxy]$"))


def _cut(word: Column, n: int | Column) -> Column:
    return F.left(word, F.length(word) - n)


def _step(word: Column, rules: dict[str, str], fits) -> Column:
    """The longest of the endings replaced where fits(stem, ending) holds."""
    ending = F.regexp_extract(word, f"({'|'.join(rules)})$", 1)
    new = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))
    change = lambda s: F.when(fits(s["stem"], s["ending"]), F.concat(s["stem"], F.element_at(new, s["ending"]))).otherwise(word)
    return F.when(word.rlike(f"({'|'.join(rules)})$"), _let(F.struct(ending.alias("ending"), _cut(word, F.length(ending)).alias("stem")), change)).otherwise(word)


def _plural_s(word: Column) -> Column:
    return (
        F.when(word.rlike("^.ies$"), _cut(word, 1))
        .when(word.rlike("(sses|ies)$"), _cut(word, 2))
        .when(word.rlike("[^s]s$|^s$"), _cut(word, 1))
        .otherwise(word)
    )


def _past(word: Column) -> Column:
    def mended(stem: Column) -> Column:
        double = (F.length(stem) >= 2) & (F.right(stem, F.lit(1)) == F.substr(stem, F.length(stem) - 1, F.lit(1))) & (F.right(shape(stem), F.lit(1)) == "c")
        return (
            F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(double, F.when(stem.rlike("[lsz]$"), stem).otherwise(_cut(stem, 1)))
            .when(measured(stem, 1) & ~measured(stem, 2) & _closed(stem), F.concat(stem, F.lit("e")))
            .otherwise(stem)
        )

    def stripped(ending: int) -> Column:
        return _let(_cut(word, ending), lambda s: F.when(F.contains(shape(s), F.lit("v")), mended(s)).otherwise(word))

    return (
        F.when(word.rlike("^.ied$"), _cut(word, 1))
        .when(word.rlike("ied$"), _cut(word, 2))
        .when(word.rlike("eed$"), F.when(measured(_cut(word, 3), 1), _cut(word, 1)).otherwise(word))
        .when(word.rlike("ed$"), stripped(2))
        .when(word.rlike("ing$"), stripped(3))
        .otherwise(word)
    )


def _final_y(word: Column) -> Column:
    return F.when(word.rlike("^..+y$"), _let(_cut(word, 1), lambda s: F.when(F.right(shape(s), F.lit(1)) == "c", F.concat(s, F.lit("i"))).otherwise(word))).otherwise(word)


def _double_suffix(word: Column) -> Column:
    shorter = F.when(word.rlike("alli$"), F.when(measured(_cut(word, 4), 1), _cut(word, 2)).otherwise(word)).otherwise(word)
    fits = lambda stem, ending: measured(F.when(ending == "logi", F.concat(stem, F.lit("l"))).otherwise(stem), 1)
    return _let(shorter, lambda w: _step(w, lists.STEM_DOUBLE, fits))


def _last_suffix(word: Column) -> Column:
    return _step(word, lists.STEM_LAST, lambda stem, ending: measured(stem, 2) & ((ending != "ion") | stem.rlike("[st]$")))


def _final_e(word: Column) -> Column:
    fits = lambda s: F.when(measured(s, 2) | (measured(s, 1) & ~_closed(s)), s).otherwise(word)
    return F.when(word.rlike("e$"), _let(_cut(word, 1), fits)).otherwise(word)


def _final_l(word: Column) -> Column:
    return F.when(word.rlike("ll$"), F.when(measured(_cut(word, 1), 2), _cut(word, 1)).otherwise(word)).otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; negations and words of up to two characters stay."""
    irregular = F.create_map(*(F.lit(x) for kv in lists.STEM_IRREGULAR.items() for x in kv))
    out = word
    for step in (_plural_s, _past, _final_y, _double_suffix, lambda w: _step(w, lists.STEM_SINGLE, lambda s, _: measured(s, 1)), _last_suffix, _final_e, _final_l):
        out = _let(out, step)
    kept = (F.length(word) <= 2) | word.isin(*lists.NEGATIONS)
    return F.when(kept, word).when(word.isin(*lists.STEM_IRREGULAR), F.element_at(irregular, word)).otherwise(out)


def lemma(word: Column) -> Column:
    """The singular of a lower-case noun, without a dictionary: irregular ones from the table, regular ones by ending; negations stay."""
    irregular = F.create_map(*(F.lit(x) for kv in lists.IRREGULAR_PLURALS.items() for x in kv))
    regular = (
        F.when(word.rlike("^[a-z]{2,}ies$"), F.concat(_cut(word, 3), F.lit("y")))
        .when(word.rlike("(ss|us|is)$"), word)
        .when(word.rlike("(ch|sh|ss|x|z)es$"), _cut(word, 2))
        .when(word.rlike("^[a-z]{3,}s$"), _cut(word, 1))
        .otherwise(word)
    )
    return F.when(word.isin(*lists.NEGATIONS), word).when(word.isin(*lists.IRREGULAR_PLURALS), F.element_at(irregular, word)).otherwise(regular)


def lemma_table(words: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of distinct words by a dictionary (word): exceptions (word, lemma) first, else the shortest, then first, of
    the word itself and its forms without an ending that the dictionary holds; a word without any stays as it is."""
    rows = words.select("word").distinct()
    forms = [F.when(F.endswith("word", F.lit(end)), F.concat(_cut(F.col("word"), len(end)), F.lit(new))) for end, new in lists.NOUN_ENDINGS]
    candidates = rows.select("word", F.explode(F.array_compact(F.array("word", *forms))).alias("form"))
    held = candidates.join(dictionary.select(F.col("word").alias("form")).distinct(), "form")
    found = held.groupBy("word").agg(F.min_by("form", F.struct(F.length("form"), "form")).alias("found"))
    out = rows.join(found, "word", "left")
    if exceptions is None:
        return out.select("word", F.coalesce("found", "word").alias("lemma"))
    known = exceptions.groupBy("word").agg(F.min("lemma").alias("known"))
    return out.join(known, "word", "left").select("word", F.coalesce("known", "found", "word").alias("lemma"))
