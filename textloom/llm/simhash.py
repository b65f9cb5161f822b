"""SimHash near-duplicates by BK-trees.

A fingerprint has 64 bits over hashed word shingles. Distinct fingerprints go to shards: one for each of radius + 1 blocks
of bits and each value of that block, as two fingerprints within the radius agree in one block at least (`near_copies` shards
by other keys, for wide radii). A shard's fingerprints form a BK-tree, whose children are keyed by their Hamming distance to the parent; a search follows only the
edges within the radius of the distance to the node. Shards beyond a bound are cut into parts, and each part's tree is sent
to the queries of every part, so that no task holds more than two parts. Trees of many shards are built and searched
together in numpy. A task returns a spanning forest of its links, not all pairs.

Cases: a null or empty text, or one of white space alone, has fingerprint zero and is linked like any other; texts of fewer
words than a shingle hash as a whole; equal texts share a fingerprint; repeated rows each get a row; rows without doc_id are linked
and link others like any other row, and a component of such rows alone has no component_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stage, text_or_empty, text_slices
from textloom.llm.components import connected_components, unite

BITS = 64
#: Fingerprints of a shard's part, at most about; pairs of query and node that a search step holds.
PART, FRONTIER = 4096, 1 << 20


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), dtype=np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array: bits set in over half of its hashes."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(hashes), dtype=np.uint64)
    if len(full):
        flat = np.concatenate([hashes[i] for i in full])
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        ones = np.zeros((len(full), BITS), dtype=np.int32)
        for k in range(BITS // 8):  # a byte of the hashes at a time, to hold little
            bits = np.unpackbits(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, k : k + 1]), axis=1, bitorder="little")
            ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_ = (2 * ones > sizes[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            fp = majority([shingle_hashes(t, width, seed) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees over groups of fingerprints: one tree a group, all built and searched together. An equal one is a child at 0."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """group: ascending group numbers."""
        self.fp, self.size = fp, np.bincount(group)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.root = np.full(len(self.size), -1, dtype=np.int64)
        self.root[group[first]] = first
        at, rest = self.root[group], np.setdiff1d(np.arange(len(fp)), first)
        keys, nodes = [], []
        while len(rest):
            key = at[rest] * (BITS + 1) + np.bitwise_count(fp[rest] ^ fp[at[rest]])
            own, new, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(own)
            nodes.append(rest[new])
            at[rest] = rest[new][which]
            rest = np.delete(rest, new)
        order = np.argsort(keys := np.concatenate([*keys, np.empty(0, np.int64)]), kind="stable")
        self.keys, self.nodes = keys[order], np.concatenate([*nodes, np.empty(0, np.int64)])[order]

    def search(self, fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) of all pairs of a query and its group's nodes within the radius, in bounded blocks."""
        cost = np.cumsum(np.where(group < len(self.size), self.size[np.minimum(group, len(self.size) - 1)], 0) + 1)
        for some in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(cost // FRONTIER)) + 1):
            some = some[group[some] < len(self.size)]
            query, node = some, self.root[group[some]]
            query, node = query[node >= 0], node[node >= 0]
            while len(query):
                d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                lo = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
                hi = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
                n = hi - lo
                query = np.repeat(query, n)
                node = self.nodes[np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def forest_links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest (u, v) of the links in each cell of frame (cell, lo, hi, part, fp, rep), sorted by cell."""
    cell = frame["cell"].to_numpy()
    group = np.cumsum(np.r_[False, cell[1:] != cell[:-1]])
    fp, rep = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy()
    tree = np.flatnonzero((frame["part"] == frame["lo"]).to_numpy())
    asks = np.flatnonzero((frame["part"] == frame["hi"]).to_numpy())
    labels = np.arange(len(frame))
    if len(tree) and len(asks):
        for query, node in BKForest(fp[tree], group[tree]).search(fp[asks], group[asks], radius):
            unite(labels, asks[query], tree[node])
    moved = np.flatnonzero(labels != np.arange(len(frame)))
    return pd.DataFrame({"u": rep[moved], "v": rep[labels[moved]]})


def whole_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by cell, cut again so that no cell is in two."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        while len(frame):
            last = frame["cell"].iloc[-1]
            if kept and kept[-1]["cell"].iloc[-1] == last:
                kept.append(frame)
                break
            cut = int(np.searchsorted(frame["cell"].to_numpy() == last, True))
            if cut or kept:
                yield pd.concat([*kept, frame.iloc[:cut]], ignore_index=True)
            kept, frame = [frame.iloc[cut:]], frame.iloc[:0]
    if kept:
        yield pd.concat(kept, ignore_index=True)


def links_in_shards(rows: DataFrame, radius: int, part: int = PART) -> DataFrame:
    """A forest (u, v) that connects the reps of a shard whose fingerprints are within the radius. rows: (shard, fp, rep)."""
    # a shard with one row has no links; what remains is joined by a shuffle at every size, as it grows with the corpus
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    rows = rows.join(sizes.hint("shuffle_hash"), "shard")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("shard", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "fp", "rep")
    rows = rows.withColumn("cell", F.xxhash64("shard", "lo", "hi"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_cells(frames):
            for _, own in frame.groupby(["lo", "hi"], sort=False):  # a cell is a hash; shards that share it are told apart here
                yield forest_links(own.assign(cell=own["shard"]).sort_values("cell", kind="stable"), radius)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "u long, v long")


def near_links(reps: DataFrame, radius: int = 2, part: int = PART) -> DataFrame:
    """A forest (u, v) that connects the reps of fingerprints within the radius. reps: (fp, rep), fp distinct."""
    width = BITS / (radius + 1)
    edges = [round(i * width) for i in range(radius + 2)]
    shards = F.array(*(F.shiftleft(F.lit(i).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.shiftleft("fp", BITS - hi), BITS - (hi - lo))) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))
    return links_in_shards(reps.select("fp", "rep", F.explode(shards).alias("shard")), radius, part)


def near_duplicates(df: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of df (doc_id, text)."""
    own = stage(fingerprints(df), "fingerprints")
    # a fingerprint is a node by its own value: its rows may all be without doc_id
    reps = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    labels = connected_components(near_links(reps.select("fp", F.col("fp").alias("rep")), radius))
    known = stage(reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component_id", "fp").alias("component")), "known", instead_of=reps)
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(known.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
