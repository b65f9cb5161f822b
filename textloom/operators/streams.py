"""Packing streams of units that are rows of any number of tasks: successor pointers on prefix sums, doubled over cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from textloom.operators.chunk import GAP
from textloom.staging import shared_path, stage

CELL = 1 << 22  # characters of a stream that one task packs at a time


def running_sums(df: DataFrame, key: str, order: list[str], value: str, name: str, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """df, staged, with the sum of a long over the rows of the same key that come before by `order`, which should be unique.

    cut: what becomes of the sorted rows before they are summed, without a shuffle; rows may become several there. What it
    costs is paid once, while df is read twice, as its ranges are found from a sample.

    A key may hold any share of all rows: rows lie in range partitions, each of which is summed as it is read. Only the key
    that a partition begins with may have rows before it, so the sums from other partitions are a row for each partition.
    """
    ranged = cut(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order))
    schema = StructType([*ranged.schema.fields]).add("_own", LongType())

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_sum = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch[key], run_end_type=pa.int64())
            lengths = np.diff(runs.run_ends.to_numpy(), prepend=0)
            values = batch[value].to_numpy()
            before = np.cumsum(values) - values
            firsts = runs.run_ends.to_numpy() - lengths
            base = -before[firsts]
            if open_key is not None and open_key.equals(runs.values[0]):
                base[0] += open_sum
            own = before + np.repeat(base, lengths)
            open_key, open_sum = runs.values[-1], int(own[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "_own"])

    staged = stage(ranged.mapInArrow(within, schema).withColumn("_part", F.spark_partition_id()), "running")
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = staged.groupBy(key, "_part").agg(F.sum(value).alias("_sum")).withColumn("_before", F.sum("_sum").over(earlier))
    offsets = sums.where("_before is not null").select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_before")
    out = staged.join(F.broadcast(offsets), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).select(*ranged.columns, name)


def successors(starts: np.ndarray, ends: np.ndarray, own: int, max_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first `own` units, where the chunk that begins with the unit ends, and the index of the unit there."""
    last = np.searchsorted(ends, starts[:own] + max_chars + len(GAP), side="right") - 1
    follow = np.maximum(last, np.arange(own)) + 1
    return ends[follow - 1], follow


def leave(ends: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each unit's path of chunks goes on behind the cell, and its chunks until there, by doubled pointers."""
    own = len(follow)
    at, hop, n = ends.copy(), follow.copy(), np.ones(own, np.int64)
    inside = np.flatnonzero(hop < own)
    while inside.size:
        over = hop[inside]
        at[inside], n[inside], hop[inside] = at[over], n[inside] + n[over], hop[over]
        inside = inside[hop[inside] < own]
    return at, n


def _sorted(units: pa.Table, cell: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The order of a cell's units, their starts and ends by it, and how many begin in the cell itself."""
    starts = units["start"].to_numpy()
    order = np.argsort(starts)
    starts = starts[order]
    return order, starts, starts + units["step"].to_numpy()[order], int(np.searchsorted(starts, (cell + 1) * size))


def _reached(links: DataFrame) -> DataFrame:
    """(stream, start) of the links (stream, start, exit) that the one from 0 leads to, in as many rounds as the logarithm of
    the longest path."""
    spark = links.sparkSession
    at = shared_path(spark, "pack-reached")
    reached = lambda: spark.read.schema(schema).parquet(at).drop("round")
    first = links.where("start = 0").select("stream", "start")
    schema = StructType([*first.schema.fields, *spark.createDataFrame([], "round int").schema.fields])
    first.write.parquet(f"{at}/round=0")
    jumps, rounds = links.select("stream", "start", "exit"), 1
    while True:
        to = jumps.select(F.col("stream").alias("_s"), F.col("start").alias("_at"), F.col("exit").alias("_to"))
        meets = (F.col("exit") == F.col("_at")) & F.col("stream").eqNullSafe(F.col("_s"))
        known = jumps.select(F.col("stream").alias("_s"), F.col("start").alias("_at"), F.col("exit"))
        entries = links.select("stream", F.col("start").alias("_entry"))
        ahead = reached().join(known, (F.col("start") == F.col("_at")) & F.col("stream").eqNullSafe(F.col("_s"))).select("stream", F.col("exit").alias("start"))
        real = ahead.alias("a").join(entries.alias("e"), (F.col("a.start") == F.col("_entry")) & F.col("a.stream").eqNullSafe(F.col("e.stream")), "left_semi")
        real.write.parquet(f"{at}/round={rounds}")
        doubled = jumps.join(to, meets).select("stream", "start", F.col("_to").alias("exit"))
        following = stage(doubled, "pack-jumps", instead_of=jumps)
        if following.isEmpty():
            return reached()
        jumps, rounds = following, rounds + 1


def pack_streams(rows: DataFrame, order: list[str], units: Column, max_chars: int = 900, overlap: int = 0, cell: int = CELL) -> DataFrame:
    """Chunks (stream, chunk_index, n_units, text) of rows that have a stream, columns that order the stream's rows, and
    what `units`, an array of texts, is made of; as `greedy_pack` and `with_overlap` give them for all of a stream's units.

    A unit's place is the running sum of the lengths before it, so the chunk that begins with a unit ends at a place found by
    binary search. Streams are cut into cells of `cell` characters, which tasks pack independently: a cell is entered at one
    of the few units near its begin, and for each of these its task finds where the next cell is entered. These links are
    followed by doubling. A stream of any length is so spread over tasks, and a short one is one cell and no link.

    Cases: null and empty units are none, nor has a null array any. A unit that is too long stays whole. Rows without stream are a stream. `order` is
    unique within a stream; of equal rows each is a unit if it is. A stream without units has no chunk. Other columns go.
    """
    if overlap < 0 or max_chars < 1 or cell < 4 * (max_chars + len(GAP)):
        raise ValueError("max_chars is at least 1, overlap at least 0, and a cell at least four chunks")
    reach = max_chars + len(GAP)

    def cut(df: DataFrame) -> DataFrame:
        # an outer one, as a plain one is guarded by a filter that computes the units too
        full = df.select("stream", F.explode_outer(units).alias("unit")).where("unit <> ''")
        return full.withColumn("step", (F.length("unit") + len(GAP)).cast("bigint"))

    placed = running_sums(rows, "stream", order, "step", "start", cut)
    own = F.floor(F.col("start") / cell).cast("bigint")
    near = (own > 0) & (F.col("start") - own * cell < reach)  # what a chunk of the cell before may reach
    cells = placed.withColumn("cell", F.explode(F.when(near, F.array(own, own - 1)).otherwise(F.array(own))))
    kind = placed.schema["stream"]

    def link(key: tuple, table: pa.Table) -> pa.Table:
        nth = key[1].as_py()
        sort, starts, ends, n_own = _sorted(table, nth, cell)
        exits, n = leave(*successors(starts, ends, n_own, max_chars))
        enter = 1 if nth == 0 else max(1, int(np.searchsorted(starts[:n_own], nth * cell + reach)))
        enter = min(enter, n_own)
        return pa.table({"stream": table["stream"].take(sort[:enter]), "start": starts[:enter], "exit": exits[:enter], "n": n[:enter]})

    def pack(key: tuple, table: pa.Table, entered: pa.Table) -> pa.Table:
        sort, starts, ends, n_own = _sorted(table, key[1].as_py(), cell) if table.num_rows else (np.array([], int),) * 3 + (0,)
        begins: list[int] = []
        if entered.num_rows:
            _, follow = successors(starts, ends, n_own, max_chars)
            at = int(np.searchsorted(starts, entered["start"][0].as_py()))
            while at < n_own:
                begins.append(at)
                at = int(follow[at])
            begins.append(at)
        texts = table["unit"].take(sort[begins[0] : begins[-1]]).to_pylist() if begins else []
        zero, chunks = begins[0] if begins else 0, list(zip(begins, begins[1:], strict=False))
        first = entered["before"][0].as_py() if begins else 0
        return pa.table(
            {
                "stream": table["stream"].take(sort[begins[:-1]]) if begins else table["stream"].slice(0, 0),
                "chunk_index": pa.array(range(first, first + len(chunks)), pa.int64()),
                "n_units": pa.array([b - a for a, b in chunks], pa.int64()),
                "text": pa.array([GAP.join(texts[a - zero : b - zero]) for a, b in chunks], pa.string()),
            }
        )

    long = lambda *names: [StructType().add(n, LongType()).fields[0] for n in names]
    links = stage(cells.select("stream", "cell", "start", "step").groupBy("stream", "cell").applyInArrow(link, StructType([kind, *long("start", "exit", "n")])), "pack-links")
    met = _reached(links).select(F.col("stream").alias("_s"), F.col("start").alias("_at"))
    path = links.join(met, (F.col("start") == F.col("_at")) & F.col("stream").eqNullSafe(F.col("_s")), "left_semi").select("stream", "start", "n")
    entered = running_sums(path, "stream", ["start"], "n", "before").select("stream", own.alias("cell"), "start", "before")
    done = StructType([kind, *long("chunk_index", "n_units")]).add("text", "string")
    chunks = cells.groupBy("stream", "cell").cogroup(entered.groupBy("stream", "cell")).applyInArrow(pack, done)
    if not overlap:
        return chunks
    chunks = stage(chunks, "pack-chunks")
    tails = chunks.select(F.col("stream").alias("_s"), (F.col("chunk_index") + 1).alias("_next"), F.right("text", F.lit(overlap)).alias("_tail"))
    met = chunks.join(tails, (F.col("chunk_index") == F.col("_next")) & F.col("stream").eqNullSafe(F.col("_s")), "left")
    return met.select("stream", "chunk_index", "n_units", F.concat_ws(GAP, "_tail", "text").alias("text"))
