"""An entity index: the names that brackets in a text hold, found once for each chunk and joined by key afterwards.

A posting is a bracket: its chunk, where it begins and ends, the end of the text right before it, and its names in order. A
question about a course joins them by chunk: those of the bracket right after the course's title, in any case of letters, or
else of the first bracket that lies in a short window from where the title first stands. Brackets may overlap: one begins at
each place where the pattern fits.

Cases: a null text has no brackets; a bracket without names is a posting still, as the first bracket counts even if it names
nobody; repeated chunks have their postings each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a title, at most; characters of the window after a title that a bracket has to lie in.
TITLE, WINDOW = 40, 60
POSTING = "idx long, start int, end int, before string, names array<string>"


@dataclass(frozen=True)
class NamePattern:  # its defaults are fixed values
    """How names are written: a bracket (one group, what it holds), what separates names, and what a whole name is like.
    Patterns are read by Python and by Java, so they keep to what both have."""

    bracket: str = r"【([^】]{2,40})】"
    separators: str = r"[,，、/；;\s\x1c-\x1f\x85   -     　]+"
    name: str = r"[一-鿿]{2,4}|[A-Z][A-Za-z]+"


@lru_cache(maxsize=4096)
def is_space(c: str) -> bool:
    """White space as Java's patterns have it, and separators."""
    return c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] == "Z"


def entity_postings(chunks: DataFrame, how: NamePattern) -> DataFrame:
    """POSTING of chunks (idx, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bracket, name = re.compile(how.bracket, re.ASCII), re.compile(how.name)
        apart = re.compile(how.separators)
        for batch in batches:
            rows = []
            for idx, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = bracket.search(text)
                while at:
                    end = at.start()
                    while end and is_space(text[end - 1]):
                        end -= 1
                    rows.append((idx, at.start(), at.end(), text[max(0, end - TITLE) : end], [n for n in apart.split(at[1]) if name.fullmatch(n)]))
                    at = bracket.search(text, at.start() + 1)
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["idx", "start", "end", "before", "names"])

    some = chunks.select(F.col("idx").cast("bigint").alias("idx"), F.col("text").cast("string").alias("text")).where("text is not null")
    return some.mapInArrow(find, POSTING)


def entities(postings: DataFrame) -> DataFrame:
    """(entity, idx, start, nth): a row for each name of each bracket."""
    return postings.select(F.posexplode("names").alias("nth", "entity"), "idx", "start").select("entity", "idx", "start", "nth")


def names_after(asked: DataFrame, postings: DataFrame, keys: list[str], title: str = "course") -> DataFrame:
    """(keys, names) of asked (keys, idx, title, text): the names of the bracket that belongs to a title in a chunk, if any.

    A chunk's postings and its titles meet by idx; for the window, the place of the title's first appearance is looked up in
    the asked row's own text.
    """
    at = F.call_function("locate", F.col(title), F.col("text"))
    rows = asked.select(*keys, "idx", F.col(title).alias("_title"), at.alias("_at")).join(postings, "idx")
    right_after = F.endswith(F.lower("before"), F.lower("_title"))
    near = (F.col("_at") > 0) & (F.col("start") >= F.col("_at") - 1) & (F.col("end") <= F.col("_at") - 1 + WINDOW)
    fit = F.when(right_after, 0).when(near, 1)
    first = rows.withColumn("_fit", fit).where("_fit is not null").groupBy(*keys).agg(F.min_by("names", F.struct("_fit", "start")).alias("names"))
    return first


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def split_names(x: Column, how: NamePattern) -> Column:
    """The names of a list, as a column."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), how.separators), lambda n: n.rlike(whole(how.name)))
