"""Sentence-packed and sliding-window chunks, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.columns import WS, col, let, strip, text
from textloom.functions.text import collapse_whitespace

GAP = "\n\n"
RUN = 256  # units that a fold appends before its output is put away


def sentences(x: Column | str) -> Column:
    """Stripped sentences; a full stop of ASCII doesn't end one."""
    parts = F.split(text(x), rf"(?<=[。！？!?；;\n]){WS}*")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def greedy_pack(units: Column, max_chars: int = 900) -> Column:
    """Units joined by empty lines while they fit. A longer unit stays whole.

    Units go in runs, as appending to an array copies it. Streams of units over many tasks: `streams.pack_streams`.
    """
    none = F.array().cast("array<string>")

    def step(acc: Column, unit: Column) -> Column:
        fits = F.length(acc["open"]) + len(GAP) + F.length(unit) <= max_chars
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), unit.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(GAP), unit).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), unit.alias("open")))
        )

    def run(acc: Column, some: Column) -> Column:
        packed = F.aggregate(some, F.struct(none.alias("done"), acc["open"].alias("open")), step)
        return let(packed, lambda p: F.struct(F.array_append(acc["done"], p["done"]).alias("done"), p["open"].alias("open")))

    full = F.filter(units, lambda u: u != "")
    runs = let(full, lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / RUN).cast("int")), lambda i: F.slice(a, i * RUN + 1, RUN)))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.lit("").alias("open"))
    last = lambda acc: F.when(acc["open"] == "", none).otherwise(F.array(acc["open"]))
    return F.aggregate(runs, start, run, lambda acc: F.flatten(F.array_append(acc["done"], last(acc))))


def with_overlap(chunks: Column, chars: int = 120) -> Column:
    """Each chunk after the end of its predecessor."""
    if chars <= 0:
        return chunks
    return let(chunks, lambda c: F.transform(c, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(c, i - 1), F.lit(chars)), F.lit(GAP), x))))


def units_of(x: Column | str, max_chars: int = 900) -> Column:
    """Paragraphs, cut to sentences if too long."""
    paragraphs = F.filter(F.transform(F.split(collapse_whitespace(x), r"\n{2,}"), strip), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(sentences(p))))


def chunk_text(x: Column | str, max_chars: int = 900, overlap: int = 120) -> Column:
    """Units of a text, packed with overlap."""
    return with_overlap(greedy_pack(units_of(x, max_chars), max_chars), overlap)


def window_chunks(x: Column | str, size: int = 900, overlap: int = 120) -> Column:
    """Windows of characters, each `size - overlap` after the last; a tail may lie within its predecessor."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = F.length(col(x))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(col(x), s + 1, F.lit(size)))
