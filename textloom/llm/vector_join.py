"""Near-duplicate vectors by an exact metric range join.

Equal vectors are one class with a weight. Classes are scaled to length 1, where a cosine of at least c is a distance of at
most r = sqrt(2 - 2c). Pivots, as many as the square root of the classes, cut the sphere into cells, a vector's home being its
nearest pivot. By the triangle inequality, a vector can have a partner in another cell only if its distance to that cell's
pivot is at most the cell's reach plus r, and its distance to the plane half-way between the pivots is at most r; only then it
is sent across the border. Cells that are near each other share a block of bounded size, large ones are cut into several. A
vector goes once to each block that holds a cell it can reach. Each pair of blocks is joined on its own, cell by cell under
the same two bounds, so no task holds more than two blocks, and each pair of vectors is met in one task only. A task returns
link counts and a spanning forest, not pairs.

The bounds prune vectors that lie in clusters. Where nearly all vectors are about as far from each other as from any pivot, as
in many dimensions without clusters, they prune little; then a vector has as many copies as there are blocks.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and keep their row;
vectors of different lengths never link; equal vectors link. Every row is compared and gives a row, also those that repeat a
vec_id or have none: n_links counts rows, component_id is the smallest vec_id of the rows reached (null if none has one), and
kept compares null as equal to null. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stage
from textloom.llm.components import connected_components, unite

#: Classes of a block, at most about; pivots of a length, at most, and lengths with pivots, which bounds what the driver holds
#: and sends to tasks; vectors that a pivot is chosen from; slack of the bounds.
BLOCK, PIVOTS, LENGTHS, SAMPLE, SLACK = 8192, 1024, 16, 4, 1e-6


def usable(column: str = "embedding"):
    """Whether a vector has a direction."""
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else tiny or huge components under- or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors x, each the one that is farthest from those before it."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


class Cells:
    """The pivots of vectors of one length, what their cells hold, and the blocks that the cells are in."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))
        self.reach = np.full(len(pivots), -1.0)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each unit vector, its distance to its pivot, and all products with pivots."""
        near = x @ self.pivots.T
        home = near.argmax(axis=1)
        return home, np.sqrt(np.maximum(2 - 2 * near[np.arange(len(x)), home], 0)), near

    def place(self, reach: np.ndarray, counts: np.ndarray, block: int) -> None:
        """Deal cells into blocks, each cell beside one that is near. A cell over a block's size has several of its own."""
        self.reach = reach
        order, left = [], np.ones(len(counts), dtype=bool)
        at = 0
        for _ in range(len(counts)):
            order.append(at)
            left[at] = False
            at = int(np.where(left, self.apart[at], np.inf).argmin())
        self.first, self.parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
        blocks: list[list[int]] = []
        room = -1
        for c in order:
            n = int(counts[c])
            if n > block:
                self.first[c], self.parts[c] = len(blocks), -(-n // block)
                blocks += [[c]] * int(self.parts[c])
                room = -1
                continue
            if n > room:
                blocks.append([])
                room = block
            blocks[-1].append(c)
            self.first[c] = len(blocks) - 1
            room -= n
        self.columns = np.array([c for b in blocks for c in b], dtype=np.int64)  # the cells, block by block
        self.starts = np.r_[0, np.cumsum([len(b) for b in blocks])[:-1]].astype(np.int64)

    def across(self, near: np.ndarray, home: np.ndarray, cells: np.ndarray, r: float) -> np.ndarray:
        """For each vector and given cell, whether the vector can have partners there. near: its products with those cells'
        pivots and, last, with its home's."""
        ball = np.sqrt(np.maximum(2 - 2 * near[:, :-1], 0)) <= self.reach[cells] + r + SLACK
        plane = near[:, -1:] - near[:, :-1] <= (r + SLACK) * self.apart[np.ix_(home, cells)]
        return (ball & plane & (self.reach[cells] >= 0)) | (home[:, None] == cells)

    def blocks_reached(self, near: np.ndarray, home: np.ndarray, r: float) -> np.ndarray:
        """For each vector and block, whether the vector can have partners there."""
        every = np.arange(len(self.pivots))
        ok = self.across(np.c_[near, near[np.arange(len(near)), home]], home, every, r)
        return np.logical_or.reduceat(ok[:, self.columns], self.starts, axis=1)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pa.compute.list_value_length(batch.column("embedding"))
    for n in pa.compute.unique(lengths).to_pylist():
        yield n, batch.filter(pa.compute.equal(lengths, n))


def links_of(a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of a, row of b) with a cosine of at least the bound, in double precision. A pass in single precision with a margin
    finds candidates."""
    b4 = b.astype(np.float32).T
    margin = np.float32(cosine - 1e-4)
    for at in range(0, len(a), 1024):
        i, j = np.nonzero(a[at : at + 1024].astype(np.float32) @ b4 >= margin)
        i = i + at
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            if ok.any():
                yield x[ok], y[ok]


def links_of_blocks(x: np.ndarray, left: np.ndarray, right: np.ndarray, home: np.ndarray, cells: Cells | None, r: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) rows of x that are linked, i in left and j in right, each pair once; left and right are the same or disjoint.

    Cell by cell of left, against the rows of right that can reach the cell.
    """
    same = left is right
    left = left[np.argsort(home[left], kind="stable")]
    right = left if same else right
    own, starts = np.unique(home[left], return_index=True)
    ends = np.r_[starts[1:], len(left)]
    if cells is not None:
        to_own = np.einsum("ij,ij->i", x[right], cells.pivots[home[right]])
    for c, lo, hi in zip(own, starts, ends, strict=True):
        others = right[lo:] if same else right
        if cells is not None:
            near = np.c_[x[others] @ cells.pivots[c], to_own[lo:] if same else to_own]
            others = others[cells.across(near, home[others], np.array([c]), r)[:, 0]]
        for i, j in links_of(x[left[lo:hi]], x[others], cosine):
            i, j = left[lo:hi][i], others[j]
            if same:
                once = (home[j] != c) | (i < j)
                i, j = i[once], j[once]
            yield i, j


def range_join(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK, max_pivots: int = PIVOTS) -> DataFrame:
    """Links of vectors (vec_id, embedding, n), n being how many rows a vector stands for: rows (a, b, n). b null: a is linked
    to n rows more; else a and b are connected.

    The pivots are chosen farthest first from the vectors of the smallest hashes of vec_id, a bounded sample that only steers
    the work. Lengths beyond
    the most frequent have one cell each, cut into as many blocks as the last of the frequent ones would need.
    """
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    cells: dict[int, Cells] = {}
    for row in lengths:
        few = min(max_pivots, math.ceil(math.sqrt(row["n"])))
        some = vectors.where(F.size("embedding") == row["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * few)
        sample = np.array([v["embedding"] for v in some.select("embedding").collect()], dtype=np.float64)
        cells[row["dim"]] = Cells(farthest_first(unit(sample), few))
    rare_parts = math.ceil(lengths[-1]["n"] / block) if lengths else 1
    r = math.sqrt(max(0.0, 2 - 2 * cosine))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                if dim in cells:
                    home, far, _ = cells[dim].homes(unit(matrix(part.column("embedding"))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim, np.int32)), pa.array(home.astype(np.int32)), pa.array(far)], names=["dim", "home", "far"])

    # a row for each pivot
    measured = vectors.select("embedding").mapInArrow(homes, "dim int, home int, far double").groupBy("dim", "home").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    for dim, c in cells.items():
        reach, counts = np.full(len(c.pivots), -1.0), np.zeros(len(c.pivots), dtype=np.int64)
        for row in measured:
            if row["dim"] == dim:
                reach[row["home"]], counts[row["home"]] = row["far"], row["n"]
        c.place(reach, counts, block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of blocks that a vector takes part in."""
        for batch in batches:
            for dim, every in by_length(batch):
                for at in range(0, len(every), 512):
                    part = every.slice(at, 512)
                    ids = part.column("vec_id").to_numpy()
                    if dim in cells:
                        c = cells[dim]
                        home, _, near = c.homes(unit(matrix(part.column("embedding"))))
                        ok, first, p = c.blocks_reached(near, home, r), c.first[home], c.parts[home]
                    else:
                        home, first, p = np.zeros((3, len(ids)), dtype=np.int64)
                        ok, p = np.ones((len(ids), rare_parts), dtype=bool), p + rare_parts
                    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    own = first + (mixed % p.astype(np.uint64)).astype(np.int64)
                    row, other = np.nonzero(ok)
                    lo, hi = np.minimum(own[row], other), np.maximum(own[row], other)
                    columns = [pa.array(np.full(len(row), dim, np.int32)), pa.array(lo), pa.array(hi), pa.array(own[row]), pa.array(home[row].astype(np.int32)), *(x.take(pa.array(row)) for x in part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "lo", "hi", "own", "home", *part.schema.names])

    def join(key: tuple, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(frames)
        dim, lo, hi = (got.column(c)[0].as_py() for c in ("dim", "lo", "hi"))
        own, home, ids, weight = (got.column(c).to_numpy() for c in ("own", "home", "vec_id", "n"))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        counts, labels = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        if len(left) and len(right):
            x = unit(matrix(got.column("embedding").combine_chunks()))
            for i, j in links_of_blocks(x, left, left if lo == hi else right, home, cells.get(dim), r, cosine):
                np.add.at(counts, i, weight[j])
                np.add.at(counts, j, weight[i])
                unite(labels, i, j)
        linked, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(ids)))
        nothing = pa.nulls(len(linked), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[linked], ids[moved]]), pa.concat_arrays([nothing, pa.array(ids[labels[moved]])]), pa.array(np.r_[counts[linked], np.zeros(len(moved), dtype=np.int64)])], names=["a", "b", "n"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    dealt = vectors.select("vec_id", "embedding", "n").mapInArrow(deal, f"dim int, lo long, hi long, own long, home int, vec_id long, embedding {kind}, n long")
    return dealt.groupBy("dim", "lo", "hi").applyInArrow(join, "a long, b long, n long")


def near_vectors(df: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of df (vec_id, embedding)."""
    kind = "array<float>" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    classes = rows.where(usable()).groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    # written and reread, so the numbers stay what they are
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = stage(range_join(classes.select(F.col("node").alias("vec_id"), "embedding", "n"), cosine, block), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    labels = connected_components(links.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = stage(labels.join(classes.select("node", "low"), "node"), "members")
    smallest = members.groupBy("component_id").agg(F.min("low").alias("least"))
    found = classes.join(counts, "node", "left").join(members.join(smallest, "component_id").select("node", "least"), "node", "left")
    found = found.select("embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("least"))
    # a vector that very many rows share is one row on the right, so adaptive execution may split its rows on the left
    out = rows.join(found, "embedding", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
