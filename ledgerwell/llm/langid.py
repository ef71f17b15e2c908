"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy, by backpropagation through time, with the document's language as the label of each of its
bytes. Texts are read whole, in segments of STEPS bytes that are worked on side by side; every byte gets a distribution, and
a document's is their mean. Training draws on at most PER_LANGUAGE labelled documents of each language (those with the least
hashed ids), and on SEGMENTS stretches of each, so the driver holds a few MB.

A null text, or one without a letter (Unicode category L), is `und` with score 0; so is every text when nothing is labelled. Null ids are neither
trained on nor held out; repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.llm.bytewise import chunks
from ledgerwell.llm.common import table

STEPS, HIDDEN = 128, 8
PER_LANGUAGE, SEGMENTS = 400, 6
ROUNDS, BATCH, RATE = 400, 128, 0.02
#: So many times as many rows as are wanted pass the cut of hashes before they are ranked.
SPARE = 4


@dataclass
class Model:
    """languages; for each direction the byte table (256 x 3H) and the recurrent weights (H x 3H); the output layer."""

    languages: list[str]
    table: list[np.ndarray]
    recur: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, *self.out, self.bias]


def new_model(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    n = len(languages)
    return Model(languages, [draw(256, 3 * hidden, scale=0.3) for _ in range(2)], [draw(hidden, 3 * hidden, scale=0.3) for _ in range(2)], [draw(hidden, n, scale=0.3) for _ in range(2)], np.zeros(n, np.float32))


def _step(given: np.ndarray, h: np.ndarray, recur: np.ndarray):
    """One step of the gated unit for many segments: update and reset gates, candidate, the recurrent part, new state."""
    k = h.shape[1]
    u = h @ recur
    gates = np.tanh(0.5 * (given[:, : 2 * k] + u[:, : 2 * k]))
    gates *= 0.5
    gates += 0.5
    z, r = gates[:, :k], gates[:, k:]
    c = np.tanh(given[:, 2 * k :] + r * u[:, 2 * k :])
    return z, r, c, u, c + z * (h - c)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def distributions(model: Model, x: np.ndarray) -> np.ndarray:
    """(steps, segments, languages) probabilities of bytes x (steps, segments)."""
    logits = np.zeros((*x.shape, len(model.languages)), np.float32)
    logits += model.bias
    for d in range(2):
        h = np.zeros((x.shape[1], model.recur[d].shape[0]), np.float32)
        for t in range(len(x))[:: 1 - 2 * d]:
            h = _step(model.table[d][x[t]], h, model.recur[d])[-1]
            logits[t] += h @ model.out[d]
    return _softmax(logits)


def gradients(model: Model, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients, in the order of weights(), for bytes x (steps, segments), labels y and a mask of real bytes."""
    steps, n = x.shape
    k = model.recur[0].shape[0]
    states, kept = [], []
    logits = np.zeros((steps, n, len(model.languages)), np.float32) + model.bias
    for d in range(2):
        h = np.zeros((n, k), np.float32)
        hs, parts = np.zeros((steps, n, k), np.float32), [None] * steps
        for t in range(steps)[:: 1 - 2 * d]:
            before = h
            z, r, c, u, h = _step(model.table[d][x[t]], h, model.recur[d])
            hs[t] = h
            parts[t] = (before, z, r, c, u[:, 2 * k :])
        logits += hs @ model.out[d]
        states.append(hs), kept.append(parts)
    p = _softmax(logits)
    count = max(1.0, float(mask.sum()))
    loss = -float((np.log(np.maximum(p[:, np.arange(n), y], 1e-9)) * mask).sum()) / count
    g = p
    g[:, np.arange(n), y] -= 1
    g *= (mask / count)[:, :, None]
    tables, recurs, outs = [], [], []
    for d in range(2):
        outs.append(states[d].reshape(-1, k).T @ g.reshape(-1, g.shape[2]))
        from_out = g @ model.out[d].T
        carried = np.zeros((n, k), np.float32)
        given = np.zeros((steps, n, 3 * k), np.float32)
        recur = np.zeros_like(model.recur[d])
        for t in range(steps)[:: 2 * d - 1]:
            before, z, r, c, uc = kept[d][t]
            dh = from_out[t] + carried
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            given[t] = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            recur += before.T @ du
            carried = dh * z + du @ model.recur[d].T
        flat, rows = x.ravel(), given.reshape(-1, 3 * k)
        tables.append(np.stack([np.bincount(flat, rows[:, j], 256) for j in range(3 * k)], 1).astype(np.float32))
        recurs.append(recur)
    return loss, [*tables, *recurs, *outs, g.sum((0, 1))]


def train(samples: list[tuple[bytes, str]], rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """A model from labelled stretches of text, by Adam on batches with as many of each language."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    model = new_model(languages, seed=seed)
    per = [[s[:STEPS] for s, lang in samples if lang == name and s] for name in languages]
    per = [p or [b" "] for p in per]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    for k in range(1, rounds + 1):
        y = rng.integers(0, len(languages), BATCH)
        picked = [per[c][rng.integers(len(per[c]))] for c in y]
        x = np.zeros((BATCH, STEPS), np.uint8)
        for row, s in zip(x, picked, strict=True):
            row[: len(s)] = np.frombuffer(s, np.uint8)
        mask = (np.arange(STEPS)[:, None] < np.array([len(s) for s in picked])[None, :]).astype(np.float32)
        _, grads = gradients(model, x.T, y, mask)
        rate = RATE * (1 - k / (rounds + 1)) ** 0.5
        for w, g, (m, v) in zip(model.weights(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model


def pooled(model: Model, raw: np.ndarray, offsets: np.ndarray, width: int = 4096) -> np.ndarray:
    """The mean distribution over all bytes of each row, for concatenated texts."""
    size = np.diff(offsets)
    count = -(-size // STEPS)
    row = np.repeat(np.arange(len(size)), count)
    start = offsets[row] + STEPS * (np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, count])[:-1], count))
    length = np.minimum(STEPS, offsets[row + 1] - start)
    total = np.zeros((len(size), len(model.languages)))
    padded = np.r_[raw, np.zeros(STEPS, np.uint8)]
    for at in range(0, len(row), width):
        part = slice(at, at + width)
        inside = np.arange(STEPS)[:, None] < length[part][None, :]
        x = padded[start[part][None, :] + np.arange(STEPS)[:, None]] * inside
        summed = (distributions(model, x) * inside[:, :, None]).sum(0)
        np.add.at(total, row[part], summed)
    return total / np.maximum(size, 1)[:, None]


def labels(model: Model, text: str) -> list[str]:
    """The language of every byte of a text."""
    raw = text.encode("utf-8")
    out: list[str] = []
    for at in range(0, len(raw), STEPS):
        x = np.zeros((STEPS, 1), np.uint8)
        part = raw[at : at + STEPS]
        x[: len(part), 0] = np.frombuffer(part, np.uint8)
        out += [model.languages[k] for k in distributions(model, x)[: len(part), 0].argmax(-1)]
    return out


def _apply(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            names, scores = [], []
            for a, b, raw, offsets in chunks(text):
                lettered = [any(map(str.isalpha, t.as_py() or "")) for t in text[a:b]]
                if model is None:
                    names += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                mean = pooled(model, raw, offsets)
                best = mean.argmax(1)
                names += [model.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                scores += [min(1.0, float(mean[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, lettered, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """Stretches of the documents of each language with the least hashed ids; labelled has doc_id, text, lang.

    A cut of the hashes, from the count of each language's ids, leaves a few times as many as are wanted; of an id that is
    repeated one row stays, so that what is ranked is bounded by languages and the sample, however many rows and partitions there are.
    """
    size = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.substr("text", (1 + F.floor(i * F.greatest(size - STEPS, F.lit(0)) / (SEGMENTS - 1))).cast("int"), F.lit(STEPS)))
    usable = labelled.where("text is not null and lang is not null and doc_id is not null")
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # a row a language, as in the model
    cut = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, int(min(1.0, SPARE * (per_language + 50) / max(r.n, 1)) * 2**53)))) if counts else F.lit(None).cast("map<string,bigint>")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    rows = usable.where(h <= F.element_at(cut, F.col("lang"))).select("doc_id", "lang", "text", h.alias("h"))
    one = rows.groupBy("lang", "h", "doc_id").agg(F.min(F.array_distinct(pieces)).alias("pieces"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = one.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    found = sorted((r.lang, r.h, r.doc_id, r.pieces) for r in chosen.select("lang", "h", "doc_id", "pieces").collect())
    return [(p.encode("utf-8"), lang) for lang, _, _, pieces in found for p in pieces]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_apply(model), "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(docs.where(~held_out(F.col("doc_id"), 3, 1))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
