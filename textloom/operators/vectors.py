"""Dense vectors: encoding, normalising, exact search for a stated set of queries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from textloom.functions.columns import col
from textloom.staging import small_batches, stage

#: Queries and vectors of a block, at most, and its bytes; vectors that are scored at once; pairs of blocks that go to a task at
#: a time.
QUERY_BLOCK, VECTOR_BLOCK, BLOCK_BYTES, SCORED, AT_ONCE = 4096, 8192, 1 << 22, 1024, 4

#: Words whose hashes the stand-in for a model keeps.
KNOWN = 50_000

#: An encoder maps a batch of texts to a matrix with a row each.
Encoder = Callable[[list[str]], np.ndarray]


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalised(x: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays."""
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(col(x), lambda v: v.cast("double") / norm)).otherwise(F.transform(col(x), lambda v: v.cast("double")))


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed hashes of words. The places of the words met last are kept."""
    known: dict[str, int] = {}

    def place(w: str) -> int:
        h = hashlib.md5(w.encode(), usedforsecurity=False).digest()
        if len(known) >= KNOWN:
            known.clear()
        known[w] = at = int.from_bytes(h[:4], "big") % dim + (dim if h[4] >> 7 else 0)
        return at

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, t in zip(out, texts, strict=True):
            words = t.lower().split()
            n = np.bincount(np.fromiter((known[w] if w in known else place(w) for w in words), dtype=np.int64, count=len(words)), minlength=2 * dim)
            row[:] = n[dim:] - n[:dim]
        return out

    return encode


def encode(df: DataFrame, encoder: Encoder, text_column: str = "text", batch: int = 32, name: str = "embedding") -> DataFrame:
    """df with a unit vector of floats for each text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                x = np.asarray(encoder(texts.iloc[at : at + batch].fillna("").tolist()), dtype=np.float64)
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                out += (x / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()
            yield pd.Series(out)

    return df.withColumn(name, run(F.col(text_column)))


def number_type(rows: DataFrame) -> type:
    """What the numbers of rows (embedding) are packed as: floats stay floats, all else goes to doubles."""
    return np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else np.float64


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(ids, matrix) of rows (id long, embedding), in blocks of at most `size` rows and BLOCK_BYTES, made where the rows are."""
    kind = number_type(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held])
            x = np.concatenate([x for _, x in held])
            return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "matrix"])

        for batch in batches:
            width = max(1, len(batch.column(1).flatten()) * kind().itemsize // max(1, batch.num_rows))
            most = max(1, min(size, BLOCK_BYTES // width))
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n and n + part.num_rows > most:
                    yield block()
                    held, n = [], 0
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                held.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), x.reshape(part.num_rows, -1)))
                n += part.num_rows
        if n:
            yield block()

    return rows.where("embedding is not null").mapInArrow(pack, "ids binary, matrix binary")


def grid(vectors: DataFrame, queries: DataFrame, n: int | None, digits: int | None) -> DataFrame:
    """(qid, idx, score), staged, of vectors (idx, embedding) and queries (qid, embedding): all, or at least each query's n best.

    Both are staged as numbered blocks, and a task scores pairs of blocks: neither the driver nor the plan has to do with how
    many queries there are. Of a block pair a task sends on what reaches the n best that the query has met in this task.
    """
    spark = vectors.sparkSession
    asks = queries.select(F.col("qid").cast("bigint").alias("id"), "embedding").where("embedding is not null and qid is not null")
    asks = asks.repartition(max(1, math.ceil(asks.count() / QUERY_BLOCK)))  # full blocks, as queries may be a few of many rows
    rows = vectors.select(F.col("idx").cast("bigint").alias("id"), "embedding").where("id is not null")
    kind, asked_kind = number_type(rows), number_type(asks)
    left, right = stage(packed(rows, VECTOR_BLOCK), "vector-blocks", large_rows=True), stage(packed(asks, QUERY_BLOCK), "query-blocks", large_rows=True)
    pairs = left.crossJoin(right.withColumnsRenamed({"ids": "asks", "matrix": "asked"}).withColumn("block", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}  # of each block of queries that this task meets, the n best scores so far
        for batch in batches:
            for ids, x, qids, q, block in zip(*batch.columns, strict=True):
                ids, qids = (np.frombuffer(i.as_buffer(), dtype=np.int64) for i in (ids, qids))
                x, q = (np.frombuffer(m.as_buffer(), dtype=k).reshape(len(i), -1) for m, i, k in ((x, ids, kind), (q, qids, asked_kind)))
                q = q.astype(np.float64)
                for at in range(0, len(ids), SCORED):
                    scores = x[at : at + SCORED].astype(np.float64) @ q.T
                    if digits is not None:
                        scores = np.round(scores, digits)
                    wanted = np.ones(scores.shape, dtype=bool)
                    if n is not None:
                        both = np.concatenate([floors.get(block.as_py(), np.full((n, len(qids)), -np.inf)), scores])
                        floors[block.as_py()] = floor = np.partition(both, len(both) - n, axis=0)[len(both) - n :]
                        wanted = scores >= floor.min(axis=0)  # ties with the last are left to the ranking
                    row, col_ = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[col_]), pa.array(ids[at + row]), pa.array(scores[row, col_])], names=["qid", "idx", "score"])

    with small_batches(spark, AT_ONCE):
        return stage(pairs.mapInArrow(run, "qid long, idx long, score double"), "scored")


def search(vectors: DataFrame, queries: DataFrame, n: int, digits: int | None = None) -> DataFrame:
    """(qid, idx, score, rank from 1): the n rows of vectors (idx, embedding) of the largest inner product with each query
    (qid, embedding)."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "idx")
    return grid(vectors, queries, n, digits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def pairwise(vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, score): the cosines of all pairs of vectors (idx, embedding), as a matrix has them. There are as many as the
    square of the vectors; they are made in blocks, so nothing but the result grows so."""
    unit = vectors.select(F.col("idx").cast("bigint").alias("idx"), normalised("embedding").alias("embedding"))
    return grid(unit, unit.withColumnRenamed("idx", "qid"), None, digits).select(F.col("qid").alias("a"), F.col("idx").alias("b"), "score")
