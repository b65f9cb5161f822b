"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word, or a piece of one over 64 characters, stands for a unit: its form if it is frequent in the sample, else its shape
(runs of letter cases, digits and marks). Each unit has a sparse ternary index vector derived from a hash; a unit's word
vector is its index vector and the sum of those of its neighbours in the sample, scaled to length 1. Only the UNITS most
frequent units have vectors of their own; others share OTHERS index vectors by hash. A document is the mean of its words'
vectors and three figures on its length and repetition. The network has one hidden layer; its logits are divided by a
temperature fitted on labelled rows that it wasn't trained on.

Training reads the whole texts of at most TRAIN_ROWS labelled documents, chosen by a hash. Words and neighbours are counted by
tasks over parts of them and summed (in integers, so that the parts make no difference); what comes to the driver is the units,
their vectors and a vector for each sampled document, on which it fits the network. Scoring is one pass over all whole texts
without shuffle.

Cases: a null or empty text is scored as a document without words; labels that are null or neither 0 nor 1 are ignored, and
of labels that repeat a doc_id the smallest counts; without any labels every score is 1, as a filter that knows nothing should
reject nothing; repeated rows each get a row; extra columns are ignored; an empty table gives no rows. Only the text is an
input of a score.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stage, text_or_empty, text_slices

#: Labelled documents that a model is trained on, at most; words whose neighbours are counted at once; parts of the sample.
TRAIN_ROWS, SLICE, PARTS = 6000, 1 << 17, 32
DIM, NONZERO, WINDOW, HIDDEN = 96, 6, 2, 24
#: Units with vectors of their own, at most, and what a form needs to be one. Other shapes share index vectors.
UNITS, LEAST, OTHERS = 6000, 20, 256
#: Words whose units a worker keeps, and words that counting holds at once, about.
CACHE_WORDS, COUNTED = 200_000, 50_000
#: Characters of a word; longer ones are several words.
LONGEST = 64
THRESHOLD = 0.3


RUNS = re.compile(r"([^\W\d_])(?:[^\W\d_])*|\d+|(.)\2*", re.DOTALL)


@functools.lru_cache(maxsize=4096)
def index_vector(unit: str, dim: int = DIM) -> np.ndarray:
    """Sparse and ternary, the same on every machine."""
    seed = int.from_bytes(hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    rng = np.random.default_rng(seed)
    out = np.zeros(dim, dtype=np.float32)
    out[rng.choice(dim, NONZERO, replace=False)] = np.where(np.arange(NONZERO) % 2, 1.0, -1.0)
    return out


def words_of(text: str) -> list[str]:
    """The words of a text. Of one over LONGEST, as in scripts without spaces, each piece is a word."""
    words = text.split()
    if max(map(len, words), default=0) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def shape(word: str) -> str:
    """Runs of letters as A (upper case), Aa (capitalised), a or mixed m; of digits as 0; of a mark as it, once or twice."""
    out = []
    for m in RUNS.finditer(word):
        run = m[0]
        if m[1]:
            out.append("A" if run.isupper() and len(run) > 1 else "a" if run.islower() else "Aa" if run[1:].islower() or len(run) == 1 else "m")
        else:
            out.append("0" if run.isdigit() else run[:2])
    return "".join(out)


def figures(words: list[str], kinds: int) -> list[float]:
    n = len(words)
    return [np.log1p(n) / 8, kinds / n if n else 0.0, sum(map(eq, words, words[1:])) / n if n else 0.0]


class Quality:
    """A trained model. Arrays only, so that it travels as bytes."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.units = {u: i for i, u in enumerate(arrays["units"].tolist())}
        self.vectors = arrays["vectors"]
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.arrays

    def __setstate__(self, arrays):
        self.__init__(arrays)

    def unit(self, word: str) -> int:
        """The row of vectors that a word stands for."""
        found = self.units.get("w:" + word.lower())
        if found is None:
            own = "s:" + shape(word)
            found = self.units.get(own)
            if found is None:
                found = len(self.units) + int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % OTHERS
        return found

    def rows_of(self, words) -> np.ndarray:
        missing = set(words).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache = {}
            missing = set(words)
        for w in missing:
            self.cache[w] = self.unit(w)
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))

    def inputs(self, text: str) -> np.ndarray:
        words = words_of(text)
        counts = Counter(words)
        out = np.zeros(DIM + 3, dtype=np.float32)
        if words:
            rows = self.rows_of(list(counts))
            weight = np.bincount(rows, np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
            used = np.flatnonzero(weight)
            out[:DIM] = weight[used].astype(np.float32) @ self.vectors[used] / len(words)
        out[DIM:] = figures(words, len(counts))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        a = self.arrays
        hidden = np.tanh((x - a["mean"]) / a["scale"] @ a["w1"] + a["b1"])
        return (hidden @ a["w2"] + a["b2"]) / a["temperature"]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z = self.logits(np.stack([self.inputs(t) for t in texts]).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_counts(texts: Iterable[str]) -> Iterator[Counter[tuple[str, str]]]:
    """Counts of (form, shape) of the words of texts, in parts of bounded size that add up."""
    shapes = functools.lru_cache(maxsize=COUNTED)(shape)
    counts: Counter[tuple[str, str]] = Counter()
    for t in texts:
        for w, n in Counter(words_of(t)).items():
            counts[w.lower(), shapes(w)] += n
        if len(counts) > COUNTED:
            yield counts
            counts = Counter()
    yield counts


def unit_counts(counts: DataFrame) -> DataFrame:
    """(unit, n) of counts (form, shape, n): the form if it is frequent, else the shape."""
    forms = counts.groupBy("form").agg(F.sum("n").alias("all"))
    own = counts.join(forms, "form").select(F.when(F.col("all") >= LEAST, F.concat(F.lit("w:"), "form")).otherwise(F.concat(F.lit("s:"), "shape")).alias("unit"), "n")
    return own.groupBy("unit").agg(F.sum("n").alias("n"))


def untrained(units: list[str]) -> Quality:
    """A model whose word vectors are the index vectors, and whose scores are 1."""
    wide = DIM + 3
    index = np.stack([index_vector(u) for u in units] + [index_vector(f"other:{i}") for i in range(OTHERS)])
    nothing = {"mean": np.zeros(wide), "scale": np.ones(wide), "w1": np.zeros((wide, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.array(40.0), "temperature": np.array(1.0)}
    return Quality({"units": np.array(units, dtype=np.str_), "vectors": index} | nothing)


def contexts(texts: Iterable[str], model: Quality) -> np.ndarray:
    """For each unit, the sum of its neighbours' index vectors. Pairs are gathered to slices; only what isn't zero is added."""
    n = len(model.units)
    own = model.vectors[:n]
    places = np.nonzero(own)[1].reshape(n, NONZERO)
    signs = np.take_along_axis(own, places, axis=1).astype(np.float64)
    out, held, size = np.zeros(n * DIM), [], 0

    def add() -> None:
        a, b = (np.concatenate([pair[i] for pair in held]) for i in (0, 1))
        out[:] += np.bincount((a[:, None] * DIM + places[b]).ravel(), signs[b].ravel(), minlength=n * DIM)

    for t in texts:
        ids = model.rows_of(words_of(t))
        for gap in range(1, WINDOW + 1):
            for at in range(0, len(ids) - gap, SLICE):
                b = ids[at + gap : at + gap + SLICE]
                a = ids[at : at + len(b)]
                ok = (a < n) & (b < n)
                held += [(a[ok], b[ok]), (b[ok], a[ok])]
                size += 2 * len(a)
                if size >= SLICE:
                    add()
                    held, size = [], 0
    if held:
        add()
    return out.reshape(n, DIM).astype(np.int64)  # sums of ones, exact


def with_contexts(model: Quality, context: np.ndarray) -> Quality:
    """The model with word vectors made of index vectors and contexts."""
    context = context / np.maximum(np.sqrt((context * context).sum(1, keepdims=True)), 1e-6)
    vectors = model.vectors / np.sqrt(NONZERO)
    vectors[: len(context)] += context
    return Quality(model.arrays | {"vectors": vectors.astype(np.float32)})


def fit_network(model: Quality, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> Quality:
    """The model with a network trained on inputs x of documents labelled y. Every fifth only fits the temperature."""
    if not len(x):
        return model
    arrays, wide = dict(model.arrays), DIM + 3
    x, y = x.astype(np.float64), y.astype(np.float64)
    held = np.arange(len(x)) % 5 == 4
    tx, ty = x[~held], y[~held]
    arrays["mean"], arrays["scale"] = tx.mean(0), tx.std(0) + 0.05
    rng = np.random.default_rng(seed)
    p = {"w1": rng.normal(0, wide**-0.5, (wide, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.array(np.log((ty.sum() + 0.5) / (len(ty) - ty.sum() + 0.5)))}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    sx = (tx - arrays["mean"]) / arrays["scale"]
    for _ in range(epochs):
        order = rng.permutation(len(sx))
        for at in range(0, len(order), 128):
            bx, by = sx[order[at : at + 128]], ty[order[at : at + 128]]
            h = np.tanh(bx @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - by) / len(bx)
            dh = np.outer(d, p["w2"]) * (1 - h * h)
            grad = {"w1": bx.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum()}
            t += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    arrays |= p
    if held.any():
        z, hy = Quality(arrays).logits(x[held]), y[held]
        loss = lambda c: float(np.mean(np.logaddexp(0, z / c) - hy * z / c))
        arrays["temperature"] = np.array(min(np.geomspace(0.3, 6, 61), key=loss))
    return Quality(arrays)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels may not be learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Quality:
    """A model from the labelled documents that aren't held out: the `rows` of the smallest hashes of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    # a repeated doc_id counts once, so the bound holds here too
    sample = stage(some.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).repartition(PARTS), "sample")
    texts_of = lambda batches: (t for part in text_slices(batches, "text") for t in part.column(part.schema.get_field_index("text")).to_pylist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in word_counts(texts_of(batches)):
            form, kind = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(kind, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["form", "shape", "n"])

    units = unit_counts(sample.select("text").mapInArrow(count, "form string, shape string, n long"))
    bare = untrained(sorted(r["unit"] for r in units.orderBy(F.desc("n"), "unit").limit(UNITS).collect()))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([contexts(texts_of(batches), bare).tobytes()], pa.binary())], names=["sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(bare.units), DIM), dtype=np.int64)
        for batch in batches:
            for sums in batch.column(0):
                out += np.frombuffer(sums.as_buffer(), dtype=np.int64).reshape(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    # at most a matrix for each part of the sample, of fixed size
    got = sample.select("text").mapInArrow(neighbours, "sums binary").repartition(1).mapInArrow(total, "sums binary").first()
    model = with_contexts(bare, np.frombuffer(got[0], dtype=np.int64).reshape(-1, DIM) if got else np.zeros((len(bare.units), DIM)))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            x = [model.inputs(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary()), part.column(2)], names=["doc_id", "x", "quality"])

    pooled = sample.select("doc_id", "text", "quality").mapInArrow(pool, "doc_id long, x binary, quality int")
    pooled = pooled.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most `rows`
    x = np.frombuffer(b"".join(r["x"] for r in pooled), dtype=np.float32).reshape(-1, DIM + 3)
    return fit_network(model, x, np.array([r["quality"] for r in pooled]))


def score(model: Quality, text: str = "text") -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = texts.tolist()
            yield pd.Series(np.concatenate([model.scores(own[i : i + 500]) for i in range(0, len(own), 500)] or [np.empty(0)]))

    return run(text_or_empty(text))


def accepted(documents: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of at least the threshold's score."""
    return documents.where(score(model) >= threshold)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), score(train(documents, labels)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
