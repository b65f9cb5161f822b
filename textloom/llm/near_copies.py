"""SimHash near-dedup of texts at a Jaccard similarity of their word shingles.

The operator of `simhash` with five-word shingles and a radius that reaches a similarity of 0.8, for the pipeline. At that
similarity fingerprints of 64 bits differ in some ten bits, sometimes in twice as many, so blocks of bits can't shard them.
Texts go to shards by MinHash keys of their shingle sets instead, BANDS keys of ROWS minima each; a shard's fingerprints form
BK-trees that are searched within RADIUS, and the shingle sets of what they link are compared, so no link is an estimate.
Texts that are linked, directly or over others, are a group; equal sets are one text.

A pair of similarity s shares no shard with probability (1 - s ** ROWS) ** BANDS, 0.00006 at 0.8, and its fingerprints differ
in more than RADIUS bits with one of about 0.00003 there; both fall fast above. Components of linked texts beyond a bound are
cut into parts, and each two parts meet in one cell.

Cases: null and empty texts, and those of white space alone, are copies of each other; texts of fewer words than a shingle are
one shingle; case of ASCII letters and kinds of white space make no difference; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stage, text_or_empty, text_slices, unused
from textloom.llm.components import connected_components, unite
from textloom.llm.simhash import links_in_shards, majority, whole_cells

WIDTH, RADIUS = 5, 24
BANDS, ROWS = 32, 6
#: Shingles and texts of a component's part, at most about.
PART_SHINGLES, PART_TEXTS = 1 << 20, 2048
STEP = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(42).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct hashes of the runs of `width` words."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(own))
    n = len(own) - width + 1
    out = own[:n].copy()
    for k in range(1, width):
        out = out * STEP + own[k : k + n]
    out ^= out >> np.uint64(31)
    out *= STEP
    out ^= out >> np.uint64(32)
    return np.unique(out)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set, none of which is empty."""
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    low, held = np.empty((len(FACTORS), len(sets)), dtype=np.uint64), np.empty_like(flat)
    for k, factor in enumerate(FACTORS):
        np.multiply(flat, factor, out=held)
        low[k] = np.minimum.reduceat(held, starts)
    out = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = (key ^ low[b * ROWS + k]) * STEP
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def keyed(df: DataFrame) -> DataFrame:
    """(doc_id, digest of the text, key of its set, size of its set, its fingerprint, bands) of the rows of df (doc_id, digest,
    text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = [shingle_set(t) for t in part.column(2).to_pylist()]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), dtype=np.uint64, count=len(sets))
            full = [i for i, s in enumerate(sets) if len(s)]
            own: list[np.ndarray | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, bands([sets[i] for i in full]).view(np.int64), strict=True):
                    own[i] = row
            columns = [part.column(0), part.column(1), pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(majority(sets).view(np.int64)), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "key", "size", "fp", "bands"])

    return df.mapInArrow(run, "doc_id long, digest long, key long, size long, fp long, bands array<long>")


def candidates(own: DataFrame) -> DataFrame:
    """(u, v): a forest of the keys whose fingerprints are within RADIUS in a shard."""
    sets = own.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))  # functions of the key
    return links_in_shards(sets.select(F.explode("bands").alias("shard"), "fp", F.col("key").alias("rep")), RADIUS)


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Labels of the groups that pairs of Jaccard similarity 0.8 or more make of the sets, compared exactly."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    where = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(where, np.cumsum([len(s) for s in sets])[:-1])
    ids = [ids[i] for i in order]
    mark, labels = np.zeros(int(where.max()) + 1, dtype=bool), np.arange(len(sets))
    for i in range(len(sets)):
        end = int(np.searchsorted(4 * sizes, 5 * sizes[i], "right"))  # larger sets can't reach 0.8
        others = i + 1 + np.flatnonzero(labels[i + 1 : end] != labels[i])
        if len(others):
            mark[ids[i]] = True
            common = np.add.reduceat(mark[np.concatenate([ids[j] for j in others])], np.r_[0, np.cumsum(sizes[others])[:-1]], dtype=np.int64)
            mark[ids[i]] = False
            near = others[9 * common >= 4 * (sizes[i] + sizes[others])]  # common / (sum - common) >= 4 / 5
            if len(near):
                unite(labels, np.full(len(near), i), near)
    out = np.empty(len(sets), dtype=np.int64)
    out[order] = order[labels]
    return out


def exact_links(texts: DataFrame) -> DataFrame:
    """A forest (u, v) that connects the keys of similar texts in each component. texts: (component_id, parts, key, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            held = pa.array([shingle_set(t).tobytes() for t in part.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), held], names=["component", "parts", "key", "held"])

    rows = texts.mapInArrow(sets, "component long, parts int, key long, held binary")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or part <> with")
    rows = rows.withColumn("cell", F.xxhash64("component", F.least("part", "with"), F.greatest("part", "with"))).select("cell", "key", "held")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_cells(frames):
            for _, cell in frame.groupby("cell", sort=False):
                key, labels = cell["key"].to_numpy(), similar([np.frombuffer(b, dtype=np.uint64) for b in cell["held"]])
                moved = np.flatnonzero(labels != np.arange(len(key)))
                yield pd.DataFrame({"u": key[moved], "v": key[labels[moved]]})

    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "u long, v long")


def one_of_each(df: DataFrame) -> DataFrame:
    """Of each group of near copies, the row of the smallest doc_id; of several texts of that doc_id, one by a fixed hash.

    Rows of one doc_id whose texts are no near copies are judged apart. A row without doc_id stays and stands for no other.
    """
    ident, digest = unused(df, "_ident", "_digest")
    named = df.withColumn(ident, F.col("doc_id").cast("long")).withColumn(digest, F.xxhash64(text_or_empty()))
    own = stage(named.where(F.col(ident).isNotNull()).select(F.col(ident).alias("doc_id"), F.col(digest).alias("digest"), text_or_empty().alias("text")).transform(keyed), "shingles")
    repeated = bool(own.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count())
    reps = stage(own.groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.max("size").alias("size")), "sets")
    coarse = stage(connected_components(candidates(own)).join(reps.withColumnRenamed("key", "node"), "node"), "candidates")
    parts = F.ceil(F.greatest(F.sum("size") / PART_SHINGLES, F.count("*") / PART_TEXTS)).cast("int")
    asked = coarse.join(coarse.groupBy("component_id").agg(parts.alias("parts")), "component_id").select("component_id", "parts", F.col("node").alias("key"), F.col("first.doc_id").alias(ident), F.col("first.digest").alias(digest))
    # by a shuffle at every size, here and below: the tables grow with the corpus, so the plan must not change to one
    texts = named.select(ident, digest, text_or_empty().alias("text")).join(asked.hint("shuffle_hash"), [ident, digest]).select("component_id", "parts", "key", "text")
    labels = connected_components(exact_links(texts.dropDuplicates(["key"]) if repeated else texts))
    known = reps.join(labels.withColumnRenamed("node", "key"), "key", "left")
    stays = stage(known.groupBy(F.coalesce("component_id", "key").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(ident), F.col("first.digest").alias(digest)), "kept")
    kept = named.join(stays.hint("shuffle_hash"), [ident, digest], "left_semi")
    if repeated:
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        kept = kept.groupBy(ident, digest).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(ident + "_row")).select(F.col(ident + "_row.*"))
    return kept.select(*df.columns).unionByName(named.where(F.col(ident).isNull()).select(*df.columns))
