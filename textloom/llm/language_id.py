"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

A text is read as its letters and marks in lower case; whatever lies between is one gap, and so are letters between two
digits, as in keys and sums. Its 1- to 4-grams, gaps included, are hashed to BUCKETS. Of the sample's n-grams the FEATURES that most texts have are kept; a text's weights are
(1 + ln count) * idf, scaled to length 1. Follow-the-regularised-leader with a penalty on absolute values and one on squares
fits a weight for each feature and language, and leaves most at zero; the logits are then divided by a temperature that every
fifth sampled text, kept from training, calibrates.

Training reads at most PER_LANGUAGE documents of a language and about TOTAL of all, those of the smallest hashes of doc_id;
their counts are made by many tasks, and one task fits the model on them, so that the driver gets the model only. Scoring is
one pass over all whole texts, a bounded piece of a text at a time, without shuffle.

Cases: a text that is null or has no letter is `und` with score 0, and so is every text where there are no labels; labels of
null are not learned; of rows that repeat a doc_id the least text is learned; repeated rows each get a row; extra columns are
ignored; an empty table gives no rows. Only the text is an input of a prediction. Equal scores go to the language that sorts
first.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stage, text_slices

#: Documents of a language that a model is trained on, at most, and of all languages, about.
PER_LANGUAGE, TOTAL = 800, 8000
LONGEST_GRAM = 4
#: Hashed n-grams (a power of two), those that have weights, and texts that must have them.
BUCKETS, FEATURES, LEAST = 1 << 20, 40_000, 2
#: Step, its smoothing, penalty on absolute values, penalty on squares, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.05, 3
#: Characters of a text that are held as arrays at once.
PIECE = 1 << 20
UNKNOWN = "und"


@cache
def signs() -> np.ndarray:
    """For each code point the one that stands for it: itself if a letter or mark, 1 for numbers, 0 for what is in between."""
    out = np.arange(0x110000, dtype=np.uint32)
    kinds = np.fromiter((ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[kinds == ord("N")] = 1
    out[~np.isin(kinds, [ord(k) for k in "LMN"])] = 0
    return out


def _without_keys(own: np.ndarray) -> np.ndarray:
    """Signs without digits and what stands between two of them."""
    if (own == 1).any():
        edges = np.flatnonzero(np.diff(np.r_[False, own > 1, False]))
        starts, ends = edges[::2], edges[1::2]
        around = np.r_[np.uint32(0), own, np.uint32(0)]
        inner = (around[starts] == 1) & (around[ends + 1] == 1)
        steps = np.zeros(len(own) + 1, dtype=np.int8)
        steps[starts[inner]], steps[ends[inner]] = 1, -1
        own = np.where((own == 1) | (np.cumsum(steps[:-1], dtype=np.int8) > 0), np.uint32(0), own)
    return own


def symbols(text: str) -> Iterator[np.ndarray]:
    """The text's signs, in lower case, with zeros for gaps, one before and one after all, in pieces. Each piece
    but the first begins with the last LONGEST_GRAM - 1 symbols of the one before."""
    tail, text = np.zeros(1, dtype=np.uint32), text.lower()
    for at in range(0, max(len(text), 1), PIECE):
        own = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = _without_keys(signs()[own])
        if at + PIECE >= len(text):
            own = np.append(own, np.uint32(0))
        whole = np.concatenate([tail, own])
        gap = whole == 0
        keep = np.r_[True, ~(gap[1:] & gap[:-1])]
        keep[: len(tail)] = True
        whole = whole[keep]
        yield whole
        tail = whole[-(LONGEST_GRAM - 1) :]


def buckets(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's n-grams, of all lengths, in pieces; each occurrence once. A gap alone is no n-gram."""
    known = 0
    for piece in symbols(text):
        h, found = np.zeros(len(piece), dtype=np.uint32), []
        for n in range(1, LONGEST_GRAM + 1):
            if len(piece) < n:
                break
            h = (h[: len(piece) - n + 1] * np.uint32(0x01000193) ^ piece[n - 1 :]) * np.uint32(0x85EBCA6B)
            new = h[max(0, known - n + 1) :] if known else h
            if n == 1:
                new = new[piece[max(0, known) :] > 0] if known else new[piece > 0]
            found.append(new)
        known = min(len(piece), LONGEST_GRAM - 1)
        all_ = np.concatenate(found)
        yield (all_ ^ (all_ >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Languages:
    """A trained model: the languages, the buckets with weights, their idf and weights, a bias, and a temperature."""

    def __init__(self, names: list[str], features: np.ndarray, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.parts = (names, features, idf, weights, bias, temperature)
        self.names, self.features, self.idf, self.weights, self.bias, self.temperature = self.parts
        self.place = np.full(BUCKETS, len(features), dtype=np.int32)
        self.place[features] = np.arange(len(features), dtype=np.int32)

    def __reduce__(self):
        return Languages, self.parts

    def logits(self, text: str) -> np.ndarray:
        counts = np.zeros(len(self.features) + 1, dtype=np.int64)
        for hashes in buckets(text):
            counts += np.bincount(self.place[hashes], minlength=len(counts))
        used = np.flatnonzero(counts[:-1])
        return (self.bias + weigh(counts[used], self.idf[used]) @ self.weights[used]) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text))
        best = int(p.argmax())
        return self.names[best], float(p[best])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a text, scaled to length 1."""
    x = (1 + np.log(np.maximum(counts, 1))) * idf
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def fit(names: list[str], texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Languages:
    """A model of texts, given as buckets and their counts, and of labels (places in names)."""
    having = np.bincount(np.concatenate([b for b, _ in texts]), minlength=BUCKETS)
    features = np.lexsort((np.arange(BUCKETS), -having))[:FEATURES]
    features = np.sort(features[having[features] >= min(LEAST, len(texts))])
    idf = np.log((1 + len(texts)) / (1 + having[features])) + 1
    start = Languages(names, features, idf, np.zeros((len(features), len(names))), np.zeros(len(names)))
    rows = []
    for own, counts in texts:
        at = start.place[own]
        known = at < len(features)
        rows.append((at[known], weigh(counts[known], idf[at[known]])))
    # the last place is the bias: a feature that every text has
    shape = (len(features) + 1, len(names))
    z, n, bias = np.zeros(shape), np.zeros(shape), len(features)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    held = np.arange(len(rows)) % 5 == 4
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for i in order.permutation(np.flatnonzero(~held)):
            at, x = np.append(rows[i][0], bias), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    # features without weight stay, as they count for a text's length
    raw = np.stack([w[-1] + x @ w[at] for at, x in rows]) if rows else np.zeros((0, len(names)))
    some = held if held.any() else ~held
    right = np.flatnonzero(some), labels[some]

    doubt = 1 / (len(right[1]) + 2)  # as if one more text had another language, else separable samples have no best temperature

    def loss(c: float) -> float:
        logs = np.log(np.maximum(softmax(raw[right[0]] / c), 1e-30))
        own = logs[np.arange(len(logs)), right[1]]
        return float(-((1 - doubt) * own + doubt * (logs.sum(1) - own) / max(len(names) - 1, 1)).mean())

    return Languages(names, features, idf, w[:-1].astype(np.float32), w[-1], min(np.geomspace(0.02, 5, 93), key=loss))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels may not be learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> DataFrame:
    """(doc_id, text, lang) of the documents to learn from: of each language those of the smallest hashes of doc_id."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").isNotNull().alias("any")).where("any and lang is not null and doc_id is not null").where(~held_out())
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    several = max(1, ids.select("lang").distinct().count())
    most = max(1, min(per_language, total // several))
    # first within parts of a language, then of what is left of it
    part, whole = (Window.partitionBy("lang", *x).orderBy(F.xxhash64("doc_id"), "doc_id") for x in (["part"], []))
    ids = ids.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(64)))
    ids = ids.repartition("lang", "part").withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= most)
    ids = ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))  # a row for each sampled document, so a broadcast has a bound
    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return some.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label"))).where("text is not null").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> Languages:
    """A model from the labelled documents that aren't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            out = []
            for text in part.column(part.schema.get_field_index("text")).to_pylist():
                pieces = [np.unique(x, return_counts=True) for x in buckets(text)] if has_letter(text) else []
                own, at = np.unique(np.concatenate([b for b, _ in pieces] or [np.empty(0, np.uint32)]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in pieces] or [np.empty(0)]), minlength=len(own))
                out.append((own.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("lang")), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], names=["doc_id", "lang", "own", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["doc_id"], r["lang"], r["own"], r["counts"]) for b in batches for r in b.to_pylist() if r["own"]), key=lambda r: r[0])
        names = sorted({r[1] for r in rows})
        if rows:
            texts = [tuple(np.frombuffer(x, dtype=np.uint32) for x in r[2:]) for r in rows]
            model = fit(names, texts, np.array([names.index(r[1]) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    counted = stage(sample(documents, per_language, total).repartition(32).mapInArrow(count, "doc_id long, lang string, own binary, counts binary"), "counted")
    got = counted.repartition(1).mapInArrow(learn, "model binary").collect()
    if not got:
        return Languages([], np.empty(0, np.int64), np.empty(0), np.zeros((0, 0)), np.empty(0))
    return pickle.loads(bytes(got[0]["model"]))


def predict(documents: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = [model.predict(t) for t in part.column(1).to_pylist()]
            lang, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return some.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
