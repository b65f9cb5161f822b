"""Packing streams over many tasks against the fold over one array."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunk, streams

SCHEMA = "stream long, i long, unit string, extra string"


def by_fold(spark, rows, max_chars, overlap):
    """What the fold makes of each stream's units."""
    whole = {}
    for stream, _, unit, _ in sorted(rows, key=lambda r: r[1]):
        whole.setdefault(stream, []).append(unit or "")
    df = spark.createDataFrame(list(whole.items()), "stream long, units array<string>")
    out = df.select("stream", F.posexplode(chunk.with_overlap(chunk.greedy_pack(F.col("units"), max_chars), overlap)))
    return {(r["stream"], r["pos"]): r["col"] for r in out.collect()}


def packed(spark, rows, max_chars, overlap, cell):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = streams.pack_streams(df, ["i"], F.array("unit"), max_chars, overlap, cell).collect()
    got = {(r["stream"], r["chunk_index"]): r["text"] for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize(("seed", "overlap", "longest"), [(1, 0, 30), (2, 7, 9), (3, 3, 400)])
def test_cells_equal_the_fold(spark, seed, overlap, longest):
    """Streams of one to hundreds of cells, units longer than a chunk and than a cell among them."""
    rng = random.Random(seed)
    rows = []
    for stream, n in [(2**53 + 1, 1500), (2**53 + 2, 40), (2**53 + 3, 1), (None, 300), (5, 3)]:
        for i in range(n):
            unit = rng.choice([None, "", "é" * rng.randrange(1, 4), "😀", *("x" * rng.randrange(1, longest) + str(i) for _ in range(6))])
            rows.append((stream, 2**53 + 2 * i + 1, unit, "e"))
    rng.shuffle(rows)
    assert packed(spark, rows, 20, overlap, 88) == by_fold(spark, rows, 20, overlap)


def test_equal_rows_and_streams_without_units(spark):
    rows = [(1, i, "same", None) for i in range(50)] + [(2, 0, "", None), (2, 1, None, None)]
    got = packed(spark, rows, 10, 0, 48)
    assert got == {(1, i): "same\n\nsame" for i in range(25)}
    assert packed(spark, [], 10, 0, 48) == {}


def test_rows_of_several_units(spark):
    df = spark.createDataFrame([(1, 0, ["a", None, "b"]), (1, 1, None), (1, 2, []), (1, 3, ["", "ccc"]), (2, 0, None)], "stream long, i int, us array<string>")
    got = streams.pack_streams(df, ["i"], F.col("us"), 4, 0, 24).orderBy("chunk_index").collect()
    assert [tuple(r) for r in got] == [(1, 0, 2, "a\n\nb"), (1, 1, 1, "ccc")]


def test_a_stream_of_a_million_units(spark):
    """A chunk's text shows its first unit; units of 9 characters and the gap fit 82 times into 900."""
    units = spark.range(10**6, numPartitions=8).select(F.lit("s").alias("stream"), F.col("id").alias("i"), F.lpad(F.col("id").cast("string"), 9, "0").alias("unit"))
    out = streams.pack_streams(units, ["i"], F.array("unit"))
    row = out.agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.sum("n_units").alias("units"), F.count_if(F.substring("text", 1, 9).cast("long") == F.col("chunk_index") * 82).alias("right")).first()
    chunks = -(-(10**6) // 82)
    assert row.asDict() == {"n": chunks, "last": chunks - 1, "units": 10**6, "right": chunks}


def test_running_sums(spark):
    rows = [(k, i, i % 5) for k in (None, "", "a", "b") for i in range(300 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(5)
    got = {(r["k"], r["i"]): r["before"] for r in streams.running_sums(df, "k", ["i"], "v", "before").collect()}
    assert got == {(k, i): sum(j % 5 for j in range(i)) for k, i, _ in rows}


@pytest.mark.parametrize("bad", [{"overlap": -1}, {"max_chars": 0}, {"cell": 900}])
def test_limits_are_checked(spark, bad):
    with pytest.raises(ValueError, match="cell"):
        streams.pack_streams(spark.createDataFrame([], SCHEMA), ["i"], F.array("unit"), **bad)


def test_the_fold_of_a_long_document(spark):
    """Runs of the fold don't show: 200,000 units give the chunks that they should, in seconds."""
    units = F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.lpad(i.cast("string"), 9, "0"))
    row = spark.range(1).select(chunk.greedy_pack(units).alias("c")).select(F.size("c").alias("n"), F.get("c", F.lit(1000)).alias("some"), F.length(F.array_join("c", "\n\n")).alias("chars")).first()
    assert (row["n"], row["some"][:9], row["chars"]) == (-(-200_000 // 82), "000082000", 200_000 * 11 - 2)
