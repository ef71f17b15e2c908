"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel of two words sums over their common subsequences of three characters, gaps included, each weighted by DECAY to
the length it spans in either word, up to SPAN characters; so `idxiot` stays close to `idiot`. It is normalised by the
words' own kernels and raised to POWER, which keeps it a kernel and lets near words stand out. The kernel of two sentences is
the sum over all pairs of their words. Landmarks are sentences of one word: words that more toxic than clean labelled documents
hold, so many that every toxic training document with such a word has one, and the clean words nearest to them. The kernel
with the landmarks, times the inverse root of theirs, is the feature space of a linear machine with squared hinge loss. Labels belong
to documents: clean documents give all sentences, a toxic one gives its most toxic sentence, chosen anew in each of ROUNDS
trainings. A document is scored by its most toxic sentence and by all together, over its whole text, and the score is
calibrated to a probability. A sentence ends at a full stop, a question or exclamation mark or a line end, and at MOST_WORDS words.

Fitting draws on at most PER_LABEL documents of each label, those with the least hashed ids, one row of each id, and on at
most MOST_SENTENCES sentences of each, those with the least hashes; near copies count once. Ids with both labels and null ids
are left out. Null and empty texts have no sentence and get the score of an empty one; words of fewer than three characters
have an empty kernel. When either label is missing, every score is 0. Repeated rows are judged one by one; long texts are worked on
whole, their words in blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.common import table
from ledgerwell.llm.langid import held_out

DECAY, SPAN, POWER = 0.6, 6, 3
PER_LABEL, MOST_SENTENCES, MOST_WORDS = 2500, 160, 200
TOXIC_LANDMARKS, NEAR_LANDMARKS, BAR = 160, 48, 10.0
ROUNDS, BENT_COST = 3, 0.5
#: Words whose scores a worker keeps, and words worked on at once (12 bits of a key).
KEPT_WORDS, BLOCK = 250_000, 4096
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_WEIGHT = np.array([DECAY ** (k + 3) for k in range(SPAN - 2)], np.float32)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_JUNK = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence in lower case; letters spelled one by one are joined, three or more of one letter are one."""
    low = _STRETCHED.sub(r"\1", (text or "").lower())
    if _SPELLED.search(low):
        low = _SPELLED.sub(lambda m: "".join(m[0].split()), low)
    cut = (s.split() for s in _SENTENCE.split(low))
    return [ws[k : k + MOST_WORDS] for ws in cut for k in range(0, len(ws), MOST_WORDS)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word, subsequence and summed weight of each different subsequence of at most BLOCK words, and the words' own kernels."""
    clean = [_JUNK.sub("", w) for w in words]
    owner = np.repeat(np.arange(len(clean), dtype=np.uint32), [len(c) for c in clean])
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((points >= 97) & (points <= 122), points - np.uint32(96), np.uint32(27) + points % np.uint32(37)).astype(np.uint32)
    keys = [np.zeros(0, np.uint32)]
    for a, b in _STEPS:  # one number holds word, three characters and the span, so that a plain sort groups them
        n = len(codes) - a - b
        if n > 0:
            inside = owner[:n] == owner[a + b :]
            keys.append(((owner[:n] << 20) | (codes[:n] << 14) | (codes[a : a + n] << 8) | (codes[a + b :] << 2) | np.uint32(a + b - 2))[inside])
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return key, key, np.zeros(0, np.float32), np.zeros(len(words))
    first = np.flatnonzero(np.r_[True, (key[1:] >> 2) != (key[:-1] >> 2)])
    weight = np.add.reduceat(_WEIGHT[key & 3], first)
    who = key[first] >> 20
    return who, (key[first] >> 2) & np.uint32(0x3FFFF), weight, np.bincount(who, weight.astype(float) ** 2, len(words))


@dataclass
class Kernel:
    """The kernel of any word with a fixed list of landmark words."""

    landmarks: list[str]
    index: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self):
        who, what, how, norm = subsequences(self.landmarks)
        used = np.unique(what)
        self.index = np.full(64**3, -1, np.int32)
        self.index[used] = np.arange(len(used))
        self.weight = np.zeros((len(used), len(self.landmarks)), np.float32)
        self.weight[self.index[what], who] = how / np.sqrt(norm[who])

    def rows(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) values of the kernel."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(words), BLOCK):
            who, what, how, norm = subsequences(words[at : at + BLOCK])
            place = self.index[what]
            hit = place >= 0
            who, place, how = who[hit], place[hit], how[hit]
            count = np.bincount(who, minlength=len(norm))
            begin = np.cumsum(np.r_[0, count])[:-1]
            for n in np.unique(count[count > 0]):  # words with as many common subsequences side by side
                own = np.flatnonzero(count == n)
                cell = begin[own][:, None] + np.arange(n)
                value = (how[cell][:, None, :] @ self.weight[place[cell]])[:, 0] / np.sqrt(norm[own])[:, None].astype(np.float32)
                out[at + own] = np.multiply.reduce([value] * POWER)
        return out


def evidence(values: list[float], bias: float, n_words: int) -> tuple[float, float, float, float]:
    """Of a document, from the kernel sums of its sentences: the most toxic one's decision, how much toxicity all have
    together, the length, by which chance finds grow, and 1."""
    best = bias + max(values, default=0.0)
    return best, float(np.log(0.05 + sum(v for v in values if v > 0))), float(np.log1p(n_words)), 1.0


@dataclass
class Model:
    kernel: Kernel
    beta: np.ndarray
    bias: float
    link: np.ndarray
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The chance that each text is toxic."""
        cut = [sentences(t) for t in texts]
        if len(self.cache) > KEPT_WORDS:
            self.cache.clear()
        known = self.cache
        new = list({w for ss in cut for s in ss for w in s if w not in known})
        for at in range(0, len(new), 4 * BLOCK):
            part = new[at : at + 4 * BLOCK]
            known.update(zip(part, (self.kernel.rows(part) @ self.beta).tolist(), strict=True))
        get = known.__getitem__
        found = np.array([evidence([sum(map(get, s)) for s in ss], self.bias, sum(map(len, ss))) for ss in cut]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(found @ self.link, -30, 30)))


def _sampled(cut: list[list[str]], most: int = MOST_SENTENCES) -> list[list[str]]:
    """At most so many of the sentences of a document, those with the least hashes, in order."""
    if len(cut) <= most:
        return cut
    ranked = sorted(range(len(cut)), key=lambda k: (zlib.crc32(" ".join(cut[k]).encode("utf-8", "surrogatepass")), k))
    return [cut[k] for k in sorted(ranked[:most])]


def _without_copies(docs: list[tuple[str, int]]) -> list[tuple[list[list[str]], int]]:
    """Sentences and label of each document but near copies, told by two pairs of least hashes of neighbouring words."""
    seen, out, names = set(), [], {}
    for text, label in docs:
        cut = [[names.setdefault(w, w) for w in s] for s in _sampled(sentences(text))]
        pairs = {f"{a} {b}".encode("utf-8", "surrogatepass") for s in cut for a, b in zip(s, [*s[1:], ""], strict=True)}
        if not pairs:
            continue
        least = [min(zlib.crc32(w, salt) for w in pairs) for salt in (1, 2, 3, 4)]
        keys = {(0, *least[:2]), (1, *least[2:])}
        if not keys & seen:
            out.append((cut, label))
        seen |= keys
    return out


def choose_landmarks(docs: list[tuple[list[list[str]], int]]) -> tuple[list[str], np.ndarray]:
    """Landmark words, the toxic ones first, and the strengths of those.

    Toxic ones are those whose share of toxic documents is beyond chance by BAR (twice the log likelihood ratio), and for a
    toxic document that holds none of them its strongest word that another document shares; at most TOXIC_LANDMARKS.
    """
    clean: dict[str, str] = {}

    def bag(cut: list[list[str]]) -> set[str]:
        """The different words of a document, cleaned."""
        for w in (w for s in cut for w in s if w not in clean):
            clean[w] = _JUNK.sub("", w)
        return {clean[w] for s in cut for w in s if len(clean[w]) >= 3}

    with_toxic, with_clean = Counter(), Counter()
    for cut, label in docs:
        if label:
            with_toxic.update(bag(cut))
    for cut, label in docs:
        if not label:
            with_clean.update(w for w in bag(cut) if w in with_toxic)  # other words are no sign of toxicity
            clean.clear()
    share = sum(label for _, label in docs) / len(docs)

    def strength(w: str) -> float:
        a, b = with_toxic[w], with_clean[w]
        p = a / (a + b)
        return 2 * (a * np.log(p / share) + (b * np.log((1 - p) / (1 - share)) if b else 0)) if p > share and a > 1 else 0.0

    strong = {w: s for w in with_toxic if (s := strength(w)) > 0}
    toxic = sorted((w for w, s in strong.items() if s > BAR), key=lambda w: (-strong[w], w))[:TOXIC_LANDMARKS]
    chosen = set(toxic)
    for cut, label in docs:
        if label and len(toxic) < TOXIC_LANDMARKS:
            held = bag(cut)
            best = max(held & strong.keys(), key=lambda w: (strong[w], w), default=None)
            if best and not held & chosen:
                toxic.append(best)
                chosen.add(best)
    near: dict[str, float] = {}
    kernel = Kernel(toxic) if toxic else None
    rest = [cut for cut, label in docs if not label]
    for at in range(0, len(rest) if kernel else 0, 256):
        words = sorted({w for cut in rest[at : at + 256] for w in bag(cut)} - chosen)
        clean.clear()
        near |= dict(zip(words, kernel.rows(words).max(1, initial=0.0).tolist(), strict=True))
        near = dict(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:NEAR_LANDMARKS])
    return toxic + [w for w, x in near.items() if x > 0], np.array([strong[w] for w in toxic])


def _machine(parts: list[np.ndarray], y: np.ndarray, cost: np.ndarray, start: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, by squared hinge loss with an L2 penalty: Newton steps on the rows inside the margin, summed over
    blocks of rows in single precision."""
    blocks = [p[at : at + 8192] for p in parts for at in range(0, len(p), 8192)]
    n, w = parts[0].shape[1], start
    ridge = np.diag(np.r_[np.full(n, penalty), 1e-9])
    for _ in range(30):
        curve, pull, at = ridge.copy(), np.zeros(n + 1), 0
        direction = w[:-1].astype(np.float32)
        for block in blocks:
            block = block.astype(np.float32)
            label, weight = y[at : at + len(block)], cost[at : at + len(block)]
            inside = label * (block @ direction + w[-1]) < 1
            at += len(block)
            label, weight, part = label[inside], weight[inside], block[inside]
            heavy = part * weight.astype(np.float32)[:, None]
            curve[:n, :n] += heavy.T @ part
            ends = heavy.sum(0, dtype=np.float64)
            curve[:n, n] += ends
            curve[n, :n] += ends
            curve[n, n] += weight.sum()
            pull[:n] += heavy.T @ label.astype(np.float32)
            pull[n] += weight @ label
        new = np.linalg.solve(curve, pull)
        if np.allclose(new, w, rtol=1e-3, atol=1e-4):
            return new
        w = new
    return w


def bent(word: str) -> list[str]:
    """A word with a letter more, at each place inside: as insults are written to pass a filter."""
    return [f"{word[:k]}x{word[k:]}" for k in range(1, len(word))]


def _values(kernel: Kernel, docs: list[tuple[list[list[str]], int]], first: np.ndarray) -> np.ndarray:
    """The kernel values of all sentences with the landmarks; a document's begin at its place in first and end with an empty one."""
    out = np.zeros((first[-1], len(kernel.landmarks)), np.float16)  # half the memory of the driver, at 3 decimals
    for at in range(0, len(docs), 256):
        part = [cut for cut, _ in docs[at : at + 256]]
        place = {w: k for k, w in enumerate(sorted({w for cut in part for s in cut for w in s}))}
        values = kernel.rows(list(place))
        for k, cut in enumerate(part, at):
            flat = np.array([place[w] for s in cut for w in s])
            out[first[k] : first[k + 1] - 1] = np.add.reduceat(values[flat], np.cumsum([0, *map(len, cut)])[:-1], axis=0)
    return out


def fit(labelled: list[tuple[str, int]]) -> Model | None:
    """A model from (text, label) pairs; None when a label is missing."""
    docs = sorted(_without_copies(labelled), key=lambda d: d[1])  # clean ones first
    label = np.array([y for _, y in docs])
    n_clean = int((label == 0).sum())
    if n_clean in (0, len(docs)):
        return None
    landmarks, strength = choose_landmarks(docs)
    n_toxic = len(strength)
    if not landmarks:
        return None
    kernel = Kernel(landmarks)
    own = kernel.rows(landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(own)))
    root = ((vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T).astype(np.float32)
    first = np.cumsum([0, *(len(cut) + 1 for cut, _ in docs)])
    x = _values(kernel, docs, first)
    spans = [slice(a, b) for a, b in zip(first[n_clean:-1], first[n_clean + 1 :], strict=True)]
    chosen = [s.start + int(x[s, :n_toxic].sum(1).argmax()) for s in spans]
    for at in range(0, len(x), 8192):
        x[at : at + 8192] = x[at : at + 8192].astype(np.float32) @ root
    virtual = [kernel.rows(bent(w)) @ root for w in landmarks[:n_toxic]]
    virtual_cost = np.concatenate([np.full(len(v), s / len(v)) for v, s in zip(virtual, strength, strict=True)])
    virtual, virtual_cost = np.concatenate(virtual), BENT_COST * virtual_cost / virtual_cost.sum()
    rest, w = x[: first[n_clean]], np.zeros(len(landmarks) + 1)
    y = np.r_[np.ones(len(chosen) + len(virtual)), -np.ones(len(rest))]
    cost = np.r_[np.full(len(chosen), 1 / len(chosen)), virtual_cost, np.full(len(rest), 1 / len(rest))]
    for _ in range(ROUNDS):
        w = _machine([x[chosen], virtual, rest], y, cost, w)
        sums = np.concatenate([x[at : at + 8192].astype(np.float32) @ w[:-1].astype(np.float32) for at in range(0, len(x), 8192)])
        chosen = [s.start + int(sums[s].argmax()) for s in spans]
    bias, beta = float(w[-1]), root @ w[:-1]
    x = np.array([evidence(sums[a:b].tolist(), bias, sum(map(len, cut))) for a, b, (cut, _) in zip(first[:-1], first[1:], docs, strict=True)])
    x = np.r_[x, np.tile(evidence([], bias, 0), (20, 1))]  # the length alone must not speak against an empty text
    label = np.r_[label, np.zeros(20)]
    link = np.zeros(4)
    for _ in range(100):  # Newton steps of the calibration
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        step = np.linalg.solve(hess, x.T @ (p - label) + 1e-2 * link)
        link = link - step / max(1.0, np.abs(step).max())
    return Model(kernel, beta.astype(np.float32), bias, link)


def _apply(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            text = row.field("text")
            out = [np.zeros(0)]
            for at in range(0, len(text), 512):
                part = text[at : at + 512].to_pylist()
                out.append(model.scores(part) if model else np.zeros(len(part)))
            yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(out), pa.float64())], ["row", "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, int]]:
    """(text, label) of at most per_label documents of each label outside the held-out part, one row of each id.

    The ids are chosen among the labels alone. A cut of the hashes, from the counts of ids, leaves about three times as many
    as are wanted before they are ranked, however many rows and partitions there are; the chosen few are broadcast to the texts.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), 5, 0))
    known = usable.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("other")).where("label = other")
    known = known.select("doc_id", "label", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("h"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    below = F.lit(False)
    for label, n in counts.items():
        below = below | (F.col("label") == label) & (F.col("h") < int(min(1.0, 3 * (per_label + 100) / n) * 2**53))
    first = Window.partitionBy("label").orderBy("h", "doc_id")
    few = known.where(below).withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_label).drop("k")
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    one = rows.groupBy("label", "h", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text")).alias("row"))
    found = one.select("label", "h", "doc_id", "row.text").collect()
    return [(r.text, r.label) for r in sorted(found, key=lambda r: (r.label, r.h, r.doc_id))]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (all columns of docs) and score for each row of docs."""
    rows = docs.select(F.struct("*").alias("row"), F.lit(0.0).alias("score"))
    return rows.select("row").mapInArrow(_apply(model), rows.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    out = scored(docs, model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
