"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns find keyword assignments, access keys and long hex runs. Further candidates are runs of 20 or more encoding
characters. For each, an alphabet is inferred; a chi-squared test of uniform symbols, a runs test about the middle of the
alphabet and a lag-1 serial correlation test are combined (Fisher) in one p-value of a random token. A second p-value is that
of ordinary text: the chi-squared value is held against its mean and variance under text-like symbol frequencies, which
depend on the length; the number of odd neighbours (letter beside digit, upper case after lower case, letter pairs that words
hardly have) is held against a share of odd ones that names, paths and long words stay below; the better of the two, times two, counts.

Both p-values pass a Benjamini-Hochberg step in each length class: a candidate is reported when ordinary text is rejected and
randomness isn't, each with a share of at most FDR false rejections among all candidates of its length. The steps work on counts
of log-spaced bins, so that no ranking of all candidates is needed.

Null text is empty and gives the digest of the empty string; spans count code points, end exclusive; a text is scanned whole,
in one expression whose work grows with its length and its spans, however long; repeated rows are judged one by one, and each counts in the steps; equal p-values share a bin
and its fate; an empty table gives an empty result; other columns are ignored, and columns of the names used here don't clash.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.common import let, table, written
from ledgerwell.llm.spans import clear_of, located, replaced

#: The kinds in order, their patterns, and the least length of the group that decides.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Encodings in the order of inference: a test and the alphabet, whose size the tests use.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Chance that two letters of text agree; for small alphabets, so many times the even chance.
TEXT_KAPPA, SMALL_KAPPA = 0.0667, 1.9
#: Second letters that are usual after a letter in words of European languages, and the share of odd neighbours in ordinary tokens.
USUAL = dict(
    a="bcdefghilmnprstuvyk", b="abeilorsu", c="acehiklorstu", d="adegiorsu", e="abcdefghilmnopqrstuvwxz", f="aefilortu", g="aeghilnorsu",
    h="aeilmnortu", i="abcdefgklmnoprstvz", j="aeou", k="aeilnorst", l="abcdefgiklmopstuvy", m="abeimopsu", n="acdefgiknostuvz",
    o="abcdfgiklmnoprstuvw", p="aehiloprstu", q="u", r="abcdefgiklmnoprstuvy", s="aceshiklmopstuw", t="aehilorstuwyz", u="abcdefgilmnprstxz",
    v="aeior", w="aehiour", x="aceipt", y="aelmnops", z="aeiouzw",
)
ODD = "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|(?i:" + "|".join(f"{a}(?=[a-z])(?![{''.join(b)}])" for a, b in USUAL.items()) + ")"
ODD_SHARE = 0.15
#: Share of false rejections in each of the two steps, and width and floor of the bins of -log10 of a p-value.
FDR = 0.01
BIN, LEAST_P = 0.05, 1e-15
#: The Chebyshev fit of Press et al. to erfc, whose relative error stays below 1.2e-7 in the tails too.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches with a long enough group, in order."""
    found = located(text, pattern, lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least if group else F.length(m) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _log_upper(z: Column) -> Column:
    """The logarithm of the normal distribution's share above z."""

    def tail(x: Column) -> Column:  # of erfc at x >= 0
        t = 1 / (1 + x / 2)
        fit = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            fit = c + t * fit
        return F.log(t / 2) - x * x + fit

    below = let(F.abs(z) / math.sqrt(2), tail)
    return F.when(z >= 0, below).otherwise(F.log(1 - F.exp(below)))


def _battery(token: Column) -> Column:
    """struct(n, p_random, p_text) of a candidate."""
    name = F.lit(len(ENCODINGS) - 1)
    for k in reversed(range(len(ENCODINGS) - 1)):
        name = F.when(token.rlike(ENCODINGS[k][1]), k).otherwise(name)

    def with_alphabet(k: Column) -> Column:
        alphabet = F.element_at(F.array(*(F.lit(e[2]) for e in ENCODINGS)), k + 1)
        plain = F.when(k == 1, F.lower(token)).when(k == len(ENCODINGS) - 1, F.translate(token, "-_", "+/")).otherwise(token)
        return F.struct(alphabet.alias("abc"), plain.alias("t"), F.length(alphabet).cast("double").alias("a"), F.length(token).cast("double").alias("n"), F.regexp_count(token, F.lit(ODD)).cast("double").alias("odd"), (k == 0).alias("digits"))

    def values(e: Column) -> Column:
        symbols = F.transform(F.sequence(F.lit(1), e["n"].cast("int")), lambda i: (F.instr(e["abc"], F.substr(e["t"], i, F.lit(1))) - 1).cast("double"))
        counts = F.transform(F.sequence(F.lit(1), e["a"].cast("int")), lambda i: (F.length(e["t"]) - F.length(F.replace(e["t"], F.substr(e["abc"], i, F.lit(1)), F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
        mean = F.aggregate(symbols, F.lit(0.0), lambda s, c: s + c) / e["n"]
        return F.struct(e["a"].alias("a"), e["n"].alias("n"), e["odd"].alias("odd"), e["digits"].alias("digits"), symbols.alias("v"), (e["a"] / e["n"] * squares - e["n"]).alias("chi"), mean.alias("mean"))

    def moments(e: Column) -> Column:
        high = F.aggregate(e["v"], F.lit(0.0), lambda s, x: s + (x >= e["a"] / 2).cast("double"))
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("var"))

        def step(s: Column, x: Column) -> Column:
            turned = ((x >= e["a"] / 2) != (s["last"] >= e["a"] / 2)).cast("double")
            return F.struct(x.alias("last"), (s["runs"] + F.coalesce(turned, F.lit(0.0))).alias("runs"), (s["lag"] + F.coalesce((x - e["mean"]) * (s["last"] - e["mean"]), F.lit(0.0))).alias("lag"), (s["var"] + (x - e["mean"]) * (x - e["mean"])).alias("var"))

        return F.struct(e["a"].alias("a"), e["n"].alias("n"), e["odd"].alias("odd"), e["digits"].alias("digits"), e["chi"].alias("chi"), high.alias("n1"), F.aggregate(e["v"], start, step).alias("w"))

    def tests(e: Column) -> Column:
        a, n, n1 = e["a"], e["n"], e["n1"]
        spread1 = 2 * (1 - 1 / n) / (a - 1) / 9  # the cube root of a sum of squares is nearly normal
        z1 = (F.cbrt(e["chi"] / (a - 1)) - (1 - spread1)) / F.sqrt(spread1)
        mu = 1 + 2 * n1 * (n - n1) / n
        spread = (mu - 1) * (mu - 2) / (n - 1)
        z2 = F.when(spread > 0, (e["w"]["runs"] - mu) / F.sqrt(spread)).otherwise(9.0)
        z3 = F.when(e["w"]["var"] > 0, (e["w"]["lag"] / e["w"]["var"] + 1 / n) * F.sqrt(n)).otherwise(9.0)
        kappa = F.greatest(F.lit(TEXT_KAPPA), SMALL_KAPPA / a)
        cube = 1.35 * kappa * kappa
        text_mean = a * (1 + (n - 1) * kappa) - n
        text_var = a * a / (n * n) * (4 * n * (n - 1) * (n - 2) * (cube - kappa * kappa) + 2 * n * (n - 1) * (kappa - kappa * kappa))
        both = lambda z: F.least(F.lit(0.0), math.log(2) + _log_upper(F.abs(z)))
        half = -(_log_upper(z1) + both(z2) + both(z3))
        combined = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        by_symbols = F.exp(_log_upper((text_mean - e["chi"]) / F.sqrt(text_var)))
        share = e["odd"] / (n - 1)
        apart = F.when(share >= 1, -math.log(ODD_SHARE)).otherwise(share * F.log(share / ODD_SHARE) + (1 - share) * F.log((1 - share) / (1 - ODD_SHARE)))
        by_pairs = F.when(share > ODD_SHARE, F.exp(-(n - 1) * apart)).otherwise(1.0)  # Chernoff's bound
        p_text = F.when(e["digits"], by_symbols).otherwise(F.least(F.lit(1.0), 2 * F.least(by_symbols, by_pairs)))
        return F.struct(n.cast("int").alias("n"), combined.alias("p_random"), p_text.alias("p_text"))

    return let(let(let(let(name, with_alphabet), values), moments), tests)


def _length_class(n: Column) -> Column:
    return F.when(n < 32, 0).when(n < 64, 1).otherwise(2)


def _tested(rows: DataFrame) -> DataFrame:
    """Adds base (spans of the patterns) and tested (other candidates with their tests) to rows with a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [f"_k{k}" for k in range(len(KINDS))]
    for name, (_, pattern, group, least) in zip(own, KINDS, strict=True):
        rows = rows.withColumn(name, _matches(text, pattern, group, least))
    rows = rows.withColumn("_cand", _matches(text, CANDIDATE, 0, 20))
    clear = F.filter("_cand", lambda c: reduce(and_, (clear_of(c, F.col(n)) for n in own)))
    span = lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), c["end"].alias("end"))
    tested = F.transform(clear, lambda c: F.struct(span(c).alias("span"), _battery(c["match"]).alias("t")))
    base = F.array_sort(F.concat(*(_ranked(F.col(n), k) for k, n in enumerate(own))))
    return rows.withColumn("base", base).withColumn("tested", tested).drop("_cand", *own)


def _level(p: Column) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(LEAST_P))) / BIN).cast("int")


def _rejected_from(tested: DataFrame, p: str) -> dict[int, int]:
    """By length class, the bin from which on the step of Benjamini and Hochberg rejects, at FDR."""
    bins = tested.select(F.explode("tested.t").alias("t")).groupBy(_length_class(F.col("t.n")).alias("c"), _level(F.col(f"t.{p}")).alias("level")).agg(F.count("*").alias("n"))
    per_class = Window.partitionBy("c")  # some 300 bins
    at_most = F.sum("n").over(per_class.orderBy(F.col("level").desc()))
    passed = bins.withColumn("ok", F.pow(F.lit(10.0), -F.col("level") * BIN) * F.sum("n").over(per_class) <= FDR * at_most)
    return {c: lv for c, lv in passed.where("ok").groupBy("c").agg(F.min("level")).collect()}  # three classes at most


def cutoffs(tested: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """By length class, the bins from which on ordinary text, and from which on randomness, is rejected."""
    return _rejected_from(tested, "p_text"), _rejected_from(tested, "p_random")


def _found(cuts: tuple[dict[int, int], dict[int, int]]) -> Column:
    """The spans of tested candidates that count as random."""

    def rejected(x: Column, p: str, cut: dict[int, int]) -> Column:
        own = F.element_at(F.array(*(F.lit(cut.get(c, 10**6)) for c in range(3))), _length_class(x["t"]["n"]) + 1)
        return _level(x["t"][p]) >= own

    return F.transform(F.filter("tested", lambda x: rejected(x, "p_text", cuts[0]) & ~rejected(x, "p_random", cuts[1])), lambda x: x["span"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns) and found (spans of random candidates) for each row of docs; the texts are read once."""
    rows = written(_tested(docs.select("doc_id", "text")).drop("text"), "secrets")
    return rows.select("doc_id", "base", _found(cutoffs(rows)).alias("found"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced in text, and n_chars, where there is one, counted again.

    Rows are written once with their tested candidates, from which both the cutoffs and the masked texts are made. Overlapping
    spans are masked as one; null and empty texts and texts without a span stay as they are, repeated rows too; all columns
    pass through, whatever their names; an empty table stays empty.
    """
    rows = written(_tested(docs.select(F.struct("*").alias("row"), "text")), "secrets")
    spans = F.transform(F.array_sort(F.concat("base", _found(cutoffs(rows)))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mask).alias("mask")))
    inner = rows.withColumn("spans", spans).withColumn("masked", F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return inner.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )
