"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors: a term is a component, its posting list the rows of a block where it isn't zero. For each
term of a query row, the weighted postings are scattered into a dense score array over the block; partition selection takes
the block's k best. Queries travel, candidates don't: a block of queries of bounded bytes is sent to all tasks, each of which
reads its candidates where they lie, block by block, and keeps each query's k best. Tasks' bests are merged by query. A job
reads the candidates once for each block of queries.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; components past
the end of a shorter vector count as zero; components so large that a score might pass 64 bits raise a ValueError; an empty vector scores 0 with all; ties go to the smaller vec_id; every row is a
candidate and, where it asks, a query, also those that repeat a vec_id, and only the query's own row is left out, so a
repeated query id has k rows for each of its rows; extra columns are ignored; fewer than k candidates give fewer rows; an
empty table gives none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stage

#: Candidates that a task scores at once, and bytes of queries that travel together, at most about.
CANDIDATES, QUERY_BYTES = 16384, 32 << 20


def quantised(column: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null where the vector takes no part."""
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~odd, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def sparse(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components that aren't zero, by term."""
    sizes = pa.compute.list_value_length(lists).to_numpy()
    weight = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(weight)
    some = some[np.argsort(term[some], kind="stable")]
    return row[some], term[some], weight[some]


class Queries:
    """Query rows and the best candidates that they have met."""

    def __init__(self, rows: np.ndarray, vectors: pa.ListArray, k: int):
        self.rows, self.k = rows, k
        row, term, weight = sparse(vectors)
        order = np.argsort(row, kind="stable")
        self.terms, self.weights = term[order].tolist(), weight[order].tolist()
        self.bounds = np.searchsorted(row[order], np.arange(len(rows) + 1))
        self.best = [np.empty((0, 3), dtype=np.int64)] * len(rows)  # (-score, id, row), ascending

    def meet(self, rows: np.ndarray, ids: np.ndarray, vectors: pa.ListArray) -> None:
        """Score a block of candidates (row number, id, vector)."""
        order = np.argsort(ids, kind="stable")  # by id, so that of equal scores the first are wanted
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        row, term, weight = sparse(vectors)
        row, rows, ids = place[row], rows[order], ids[order]
        starts = np.searchsorted(term, np.arange(term.max() + 2 if len(term) else 1))
        lists = [(row[a:b], weight[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        lists = [(slice(None), w[np.argsort(r)]) if len(r) == len(ids) else (r, w) for r, w in lists]  # a full list needs no rows
        by_row = np.argsort(rows)
        at = np.searchsorted(rows[by_row], self.rows)
        own = np.where(at < len(rows), by_row[np.minimum(at, len(rows) - 1)], 0)
        is_own = rows[own] == self.rows
        for q in range(len(self.rows)):
            scores = np.zeros(len(ids), dtype=np.int64)
            for t, w in zip(self.terms[self.bounds[q] : self.bounds[q + 1]], self.weights[self.bounds[q] : self.bounds[q + 1]], strict=True):
                if t < len(lists):
                    some, weights = lists[t]
                    scores[some] += w * weights
            if is_own[q]:
                scores[own[q]] = np.iinfo(np.int64).min
            n = min(self.k, len(ids) - int(is_own[q]))
            if n <= 0:
                continue
            kth = np.partition(scores, len(ids) - n)[len(ids) - n]
            above = np.flatnonzero(scores > kth)
            found = np.r_[above, np.flatnonzero(scores == kth)[: n - len(above)]]
            both = np.concatenate([self.best[q], np.stack([-scores[found], ids[found], rows[found]], axis=1)])
            self.best[q] = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))[: self.k]]


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row where is_query holds."""
    spark = df.sparkSession
    asks = F.coalesce(is_query, F.lit(False))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), quantised(vector_column, scale).alias("v"), asks.alias("asks")).where("vec_id is not null and v is not null")
    # written and reread, so the numbers stay what they are
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "quantised")
    asking = rows.where("asks").select("row", "vec_id", "v")
    seen = rows.agg(F.sum(F.when(F.col("asks"), 8 * F.size("v") + 64)), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    size, longest, high, low = (x or 0 for x in seen)
    if longest * max(high, -low) ** 2 >= 1 << 63:
        raise ValueError(f"scores of {longest} components from {low} to {high} may pass 64 bits")
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    found = []
    for block in range(blocks):
        # of bounded size, whatever the table's
        some = asking.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        sent = spark.sparkContext.broadcast((some.column("row").to_numpy(), some.column("vec_id").to_numpy(), some.column("v").combine_chunks()))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, ids, vectors = sent.value
            queries = Queries(names, vectors, k) if len(names) else None
            for part in grouped(batches, CANDIDATES):
                if queries:
                    queries.meet(part.column("row").to_numpy(), part.column("vec_id").to_numpy(), part.column("v").combine_chunks())
            if queries:
                best = np.concatenate(queries.best)
                q = np.repeat(np.arange(len(names)), list(map(len, queries.best)))
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[q]), pa.array(best[:, 1]), pa.array(best[:, 2]), pa.array(-best[:, 0])], names=["asks", "query_id", "vec_id", "row", "score"])

        found.append(rows.select("row", "vec_id", "v").mapInArrow(score, "asks long, query_id long, vec_id long, row long, score long"))
        if blocks > 1:
            found[-1] = stage(found[-1], "best")
            sent.destroy()
    best = functools.reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("asks").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches as tables of at least `rows` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
