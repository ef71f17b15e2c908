"""Column functions over text: cleaning, tokens, windows, screens, citations, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwell.functions import lists, stems

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word: letters and digits, with single inner hyphens, dots and apostrophes.
WORD = r"([\p{L}\p{N}]+(?:[-.'][\p{L}\p{N}]+)*)"
_TOKEN = r"([a-z][a-z\-]{2,})"


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Space-separated tokens of collapsed text; none for empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def word_count(text: Column) -> Column:
    return F.size(tokens(collapse(text))).cast("long")


#: Named bundles of the switches of clean().
PROFILES = {
    "minimal": {},
    "stopwords": {"stop_words": True},
    "aggressive": {"punctuation": True, "numbers": True, "stop_words": True, "keep_negation": False, "stem": True},
    "readable": {"stop_words": True, "lemmatize": True},
}
DEFAULT_PROFILE = "readable"


def clean(text: Column, urls: bool = True, lower: bool = True, punctuation: bool = False, numbers: bool = False, spaces: bool = True, stop_words: bool = False, keep_negation: bool = True, stem: bool = False, lemmatize: bool = False) -> Column:
    """The cleaner with its switches, in fixed order. Only a token switch cuts words, and so drops the punctuation between them."""
    out = F.coalesce(text, F.lit(""))
    if urls:
        out = F.regexp_replace(out, r"https?://\S+", "")
    if lower:
        out = F.lower(out)
    if punctuation:
        out = F.translate(out, PUNCTUATION, "")
    if numbers:
        out = F.regexp_replace(out, r"\b\d+\b", "")
    if spaces:
        out = collapse(out)
    if stop_words or stem or lemmatize:
        words = F.regexp_extract_all(out, F.lit(WORD), F.lit(1))
        if stop_words:
            drop = [w for w in lists.STOP_WORDS if not keep_negation or w not in lists.NEGATIONS]
            words = F.filter(words, lambda w: ~w.isin(*drop))
        if stem:
            words = F.transform(words, stems.stem)
        if lemmatize:
            words = F.transform(words, stems.lemma)
        out = F.array_join(words, " ")
    return out


def cleaned(text: Column, profile: str = DEFAULT_PROFILE) -> Column:
    return clean(text, **PROFILES[profile])


def windows(text: Column, size: int = 90, overlap: int = 25) -> Column:
    """Overlapping word windows as an array; a text of at most `size` words is one window, as it stands."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(many)

    return F.transform(F.array(F.transform(F.array(collapse(text)), tokens)[0]), cut)[0]


def identity_tokens(name: Column, drop=lists.SALT_WORDS) -> Column:
    """Distinct tokens of a name that identify it."""
    return F.array_except(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(_TOKEN), F.lit(1)), _array(drop))


def salient_terms(query: Column) -> Column:
    """Distinct words of a query that could name an entity, in order."""
    drop = dict.fromkeys((*lists.STOP_WORDS, *lists.QUESTION_WORDS, *lists.SALT_WORDS))
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(_TOKEN), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*drop)))


def normalise(query: Column) -> Column:
    """Lower case, single spaces, shorthand written out inside its punctuation."""
    long = F.create_map(*(F.lit(x) for kv in lists.ABBREVIATIONS.items() for x in kv))

    def expand(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^[.,;:?!()]+|[.,;:?!()]+$", "")
        return F.when(F.map_contains_key(long, bare), F.replace(t, bare, F.element_at(long, bare))).otherwise(t)

    return F.array_join(F.transform(tokens(F.lower(collapse(query))), expand), " ")


def redact(text: Column, rules=lists.REDACTIONS) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, mark in rules:
        out = F.regexp_replace(out, pattern, mark.replace("[", "\\[").replace("]", "\\]"))
    return out


def without_scratchpad(text: Column) -> Column:
    """Drops <think> blocks; where nothing else is left, the trimmed original stays."""
    left = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    return F.when(left == "", F.trim(text)).otherwise(left)


def with_disclaimer(text: Column, disclaimer: str) -> Column:
    return F.when(F.contains(F.lower(text), F.lit("not medical advice")), text).otherwise(F.concat(text, F.lit("\n\n" + disclaimer)))


def citations(answer: Column) -> Column:
    """Distinct cited source numbers, sorted; numbers that are too long are none."""
    found = F.regexp_extract_all(answer, F.lit(r"\[Source\s+([0-9]+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda n: n.try_cast("int")), lambda n: n.isNotNull())))


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*lists.OVERLAP_STOP_WORDS))


def overlap(answer: Column, context: Column) -> Column:
    """Share of the answer's content words that the context has; 0 without any."""
    known = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(context, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))
    words = content_words(answer)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(known, w))) / F.size(words))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    return F.array_sort(F.array_except(numbers(answer), numbers(context)))


def without_prefix(text: Column) -> Column:
    """Drops the `Name — field: ` in front of a chunk."""
    return F.regexp_replace(text, r"^.*? — .*?:\s*", "")


def snippet(text: Column, size: int = 400) -> Column:
    return F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "…").otherwise(""))


def card_snippet(text: Column, title: Column, field: Column, size: int = 320) -> Column:
    """The start of a chunk without the heading that names its own title and field, cut to size and trimmed on the right."""
    heading = F.concat(title, F.lit(" — "), field, F.lit(": "))
    body = F.when(F.startswith(text, heading), F.substr(text, F.length(heading) + 1)).otherwise(text)
    return F.when(F.length(body) > size, F.concat(F.regexp_replace(F.substring(body, 1, size), r"\s+$", ""), F.lit("…"))).otherwise(body)


def citation_label(title: Column, field: Column) -> Column:
    return F.concat(title, F.lit(" · "), field)


def link(pattern: str, name: Column) -> Column:
    """A URL with a name in place of {}, percent-encoded but for slashes."""
    before, _, after = pattern.partition("{}")
    safe = F.url_encode(name)
    for raw, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        safe = F.replace(safe, F.lit(raw), F.lit(code))
    return F.concat(F.lit(before), safe, F.lit(after))


def highlight(text: Column, query: str) -> Column:
    """Text as HTML with the query's words marked, longest first."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    terms = {t for t in re.findall(r"[a-z][a-z\-]{3,}", query.lower()) if t not in lists.HIGHLIGHT_STOP_WORDS}
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, rf"(?i)(?<![\w>])({re.escape(term)}\w*)", '<mark class="hl">$1</mark>')
    return out


def is_red_flag(query: Column) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"\s+", " "), F.lit(" "))
    return F.exists(_array(lists.RED_FLAGS), lambda f: F.contains(padded, f))


def is_medication_change(query: Column) -> Column:
    return F.coalesce(query, F.lit("")).rlike("(?i)" + lists.MEDICATION_CHANGE)


def is_dosing_imperative(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?im)" + lists.DOSING_IMPERATIVE)


def asks_interaction(query: Column) -> Column:
    low = F.lower(F.coalesce(query, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1))
    out = F.arrays_overlap(words, _array(lists.INTERACTION_WORDS))
    for phrase in lists.INTERACTION_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out
