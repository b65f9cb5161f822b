"""Phrase collocations by hashed counters and exact counts of what may be frequent.

Texts of one language are put together to blocks of about BLOCK bytes: a sequence of places, each with a word or a break. For
k = 1 up to the longest phrase, each task adds up its k-grams' hashes in counters of one byte (which stop at the limit); these
are summed over tasks, and a k-gram whose counter stays below the limit can't reach it. Only k-grams are counted whose first
and last k-1 words may be frequent by the counters before. The counters' bits are the only thing that all tasks get.

Then one more pass takes all k-grams that may be frequent out of the blocks, as phrases: a task's rows are summed up where they
lie and once more over all tasks, by the phrase itself, so that hashes only choose what is counted and never what is equal.
Sequences stay where they are, and no row of a block joins anything. Frequent phrases join those that are one word shorter (the
phrase without its last and without its first word): along them a phrase gathers the counts of all its first and last parts,
which are the cuts, and by them a phrase finds those one word longer that contain it.

There are BUCKETS counters, more on larger inputs (one for PER_COUNTER words), MOST of them at most; if they all fill, nothing
is filtered and the result is the same.

Cases: a null text is empty; a null language is `und`; repeated rows count each; other columns are ignored, whatever their
names; an empty table gives no rows. A language's places are numbered by score and count (both descending), then by phrase in
UTF-8 byte order. The score's factors are decimals of 38 digits: exact while 1000 * a * n is below 10^38.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, stage, text_or_empty, text_slices

#: Words of a phrase, at most; its occurrences, at least; phrases of a language, at most.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of a block, about, and of all blocks that a task has begun.
BLOCK, OPEN = 2 << 20, 8 << 20
#: Blocks and texts that go to a task at a time.
AT_ONCE, TEXTS = 4, 256
#: Counters that tell what may be frequent (a power of two), at least and at most; words for each; parts that they are summed in.
BUCKETS, MOST, PER_COUNTER, CHUNKS = 1 << 22, 1 << 27, 32, 256
#: Bytes of staged blocks that a task counts, where all cores are busy: what it sums up is sent once, not for each few blocks.
SPLIT = 128 << 20
#: Bytes of counted phrases that a task holds before it sums them up, and rows that it hands on at a time.
HELD, ROWS = 32 << 20, 20_000
#: Parts that a language is ranked in before its best are ranked together.
SALTS = 64
UNKNOWN = "und"
#: Upper to lower case, tabulators to spaces, and all that ends a piece to one mark.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"." * 10)


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = found = len(self)
        return found


@contextmanager
def _few_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside read blocks in splits of SPLIT bytes, or less where cores would be idle, and a few at a time."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SPLIT))
    try:
        with small_batches(spark, AT_ONCE):
            yield
    finally:
        spark.conf.set(key, before)


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about `size` bytes of a plain text, cut only at its marks."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b".", at, at + size)
        cut = data.find(b".", at + size) if cut <= at else cut
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _kind(words) -> type:
    """The numbers that count a block's distinct words."""
    return np.uint16 if len(words) < 1 << 16 else np.int32


def _block(lang: str, parts: list[bytes], number: int) -> pa.RecordBatch:
    """A block's row: its distinct words, their hashes, and its sequence of them (from 1; 0: a break)."""
    words = b".".join(parts).replace(b".", b" . ").split()
    numbers = _Numbers({b".": 0})
    at = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))
    own = list(numbers)[1:]
    salt = zlib.crc32(lang.encode())
    hashes = np.fromiter((zlib.crc32(w, salt) for w in own), dtype=np.uint32, count=len(own))
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([lang]), pa.array([len(words) - words.count(b".")]), pa.array([own], pa.list_(pa.string())), pa.array([hashes.tobytes()], pa.binary()), pa.array([at.astype(_kind(own)).tobytes()], pa.binary())],
        names=["block", "lang", "total", "words", "hashes", "places"],
    )


def word_blocks(documents: DataFrame) -> DataFrame:
    """The blocks of all texts, staged."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, begun, sizes = TaskContext.get().partitionId() << 32, {}, {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            sizes.pop(lang)
            return _block(lang, begun.pop(lang), number)

        for part in text_slices(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for piece in _pieces(text.translate(PLAIN), BLOCK):
                    begun.setdefault(lang, []).append(piece)
                    sizes[lang] = sizes.get(lang, 0) + len(piece) + 1
                    if sizes[lang] >= BLOCK:
                        yield close(lang)
                    elif sum(sizes.values()) >= OPEN:
                        yield close(max(sizes, key=sizes.get))
        for lang in list(begun):
            yield close(lang)

    some = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().alias("text"))
    with small_batches(some.sparkSession, TEXTS):
        return stage(some.mapInArrow(build, "block long, lang string, total long, words array<string>, hashes binary, places binary"), "words")


def possible(counted: DataFrame, least: int) -> np.ndarray:
    """Whether each counter reaches `least` (below 256). counted: (chunk int, counters binary), counters stopped at `least`."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counters in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counters.as_buffer(), dtype=np.uint8).astype(np.uint16)
                sums[chunk] = np.minimum(sums.get(chunk, 0) + own, least).astype(np.uint8)
        for chunk, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(own >= least).tobytes()], pa.binary())], names=["chunk", "bits"])

    with small_batches(counted.sparkSession, AT_ONCE):
        found = counted.repartition(CHUNKS // 4, "chunk").mapInArrow(total, "chunk int, bits binary").collect()  # a bit for each counter
    size = len(found[0]["bits"]) * 8 if found else BUCKETS // CHUNKS
    out = np.zeros((CHUNKS, size), dtype=bool)
    for r in found:
        out[r["chunk"]] = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8))
    return out.ravel()


def _hashes(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on."""
    size = len(word) - k + 1
    out = word[:size]
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[j : size + j]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _may(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the counters of these hashes have reached the limit, by all counters' bits (eight to a byte, the lowest first)."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)


def _grams(at: np.ndarray, word: np.ndarray, k: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a block where k-grams begin whose first and last k-1 words may be frequent, and their hashes."""
    size = len(at) - k + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    here = at[:size] >= 0
    for j in range(1, k):
        here &= at[j : size + j] >= 0
    if before is not None:
        part = _may(before, _hashes(word, k - 1))
        here &= part[:-1] & part[1:]
    place = np.flatnonzero(here)
    return place, _hashes(word, k)[place]


def _sequence(places: pa.Scalar, hashes: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """A block's sequence of words (-1: a break), and of their hashes."""
    own = np.frombuffer(hashes.as_buffer(), dtype=np.uint32)
    at = np.frombuffer(places.as_buffer(), dtype=_kind(own)).astype(np.int32) - 1
    return at, np.append(own, np.uint32(0)).astype(np.uint64)[at]  # the last is for breaks


def possible_grams(blocks: DataFrame, k: int, least: int, buckets: int, before: np.ndarray | None) -> np.ndarray:
    """The bits of the counters of k-grams (see _may), by those of (k-1)-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, dtype=np.uint8)
        for batch in batches:
            for places, hashes in zip(*batch.columns, strict=True):
                _, found = _grams(*_sequence(places, hashes), k, before)
                used, n = np.unique((found & np.uint64(buckets - 1)).astype(np.uint32), return_counts=True)
                own[used] = np.minimum(own[used] + n, least)
        own = own.reshape(CHUNKS, -1)
        for i in np.flatnonzero(own.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own[i].tobytes()], pa.binary())], names=["chunk", "counters"])

    with _few_tasks(blocks.sparkSession):
        return np.packbits(possible(blocks.select("places", "hashes").mapInArrow(count, "chunk int, counters binary"), least), bitorder="little")


def _phrases(words: pa.Array, at: np.ndarray, place: np.ndarray, hashes: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k-grams at some places of a block, and how often each occurs (a gram may come twice where hashes are equal)."""
    place = place[np.argsort(hashes)]
    columns = [at[place + j] for j in range(k)]
    first = np.ones(len(place), dtype=bool)
    if len(place):
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(first)
    parts = [words.take(pa.array(c[starts])) for c in columns]
    return (pa.compute.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]), np.diff(starts, append=len(place))


def frequent_phrases(blocks: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to `longest` words with `least` occurrences or more, staged."""
    total = blocks.agg(F.sum("total")).first()[0] or 0
    buckets = min(MOST, max(BUCKETS, 1 << (total // PER_COUNTER).bit_length()))
    enough, levels = min(least, 255), []
    for k in range(1, longest + 1):
        levels.append(possible_grams(blocks, k, enough, buckets, levels[-1] if levels else None))
        if not levels[-1].any():
            levels.pop()
            break

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "k", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "k", "phrase", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lang, words, hashes, places in zip(*batch.columns, strict=True):
                at, word = _sequence(places, hashes)
                for k, bits in enumerate(levels, 1):
                    place, found = _grams(at, word, k, levels[k - 2] if k > 1 else None)
                    keep = _may(bits, found)
                    phrase, n = _phrases(words.values, at, place[keep], found[keep], k)
                    some = pa.table({"lang": pa.array([lang.as_py()] * len(n), pa.string()), "k": pa.array(np.full(len(n), k, dtype=np.int32)), "phrase": phrase, "n": pa.array(n, pa.int64())})
                    held.append(some)
                    size += some.nbytes
                if size >= HELD:
                    held = [summed(held)]
                    size = held[0].nbytes
                    if size >= HELD // 2:
                        yield from held[0].to_batches(max_chunksize=ROWS)
                        held, size = [], 0
        if held:
            yield from summed(held).to_batches(max_chunksize=ROWS)

    with _few_tasks(blocks.sparkSession):
        rows = blocks.select("lang", "words", "hashes", "places").mapInArrow(choose, "lang string, k int, phrase string, n long")
        return stage(rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent")


def with_parts(own: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Frequent k-grams (lang, phrase, f) with the phrases without their last and first word (start, end), and the counts of all
    their first and last parts, by those of (k-1)-grams."""
    own = own.select("lang", "phrase", "f", F.substring_index("phrase", " ", k - 1).alias("start"), F.substring_index("phrase", " ", 1 - k).alias("end"))
    head = shorter.select("lang", F.col("phrase").alias("start"), F.col("firsts").alias("before"))
    tail = shorter.select("lang", F.col("phrase").alias("end"), F.col("lasts").alias("behind"))
    return own.join(head, ["lang", "start"]).join(tail, ["lang", "end"]).select(
        "lang", "phrase", "f", "start", "end", F.concat("before", F.array("f")).alias("firsts"), F.concat("behind", F.array("f")).alias("lasts")
    )


def best_cut(k: int) -> Column:
    """(score, cut, l, r) of the lowest-scoring cut of a k-gram with columns f, n, firsts and lasts."""
    cuts = []
    for i in range(1, k):
        left, right = F.col("firsts")[i - 1], F.col("lasts")[k - i - 1]
        score = F.expr(f"(cast(1000 as decimal(4,0)) * cast(f as decimal(19,0)) * cast(n as decimal(19,0))) div cast(cast(firsts[{i - 1}] as decimal(19,0)) * cast(lasts[{k - i - 1}] as decimal(19,0)) as decimal(38,0))")
        cuts.append(F.struct(score.alias("score"), F.lit(i).alias("cut"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words with `least` occurrences
    or more that no phrase one word longer explains whole."""
    blocks = word_blocks(documents)
    totals = blocks.groupBy("lang").agg(F.sum("total").alias("n"))
    found = frequent_phrases(blocks, longest, least)
    levels = [found.where("k = 1").select("lang", "phrase", F.array("f").alias("firsts"), F.array("f").alias("lasts"))]
    for k in range(2, longest + 1):
        levels.append(stage(with_parts(found.where(F.col("k") == k), levels[-1], k), f"frequent-{k}"))
    scored = None
    for k in range(2, longest + 1):
        own = levels[k - 1]
        if k < longest:
            # an occurrence of a longer phrase is one of each of its parts: what explains a phrase has one word more
            longer = levels[k].select("lang", F.explode(F.array("start", "end")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            own = own.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * f")
        own = own.join(totals, "lang").withColumn("best", best_cut(k)).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
        scored = own if scored is None else scored.unionByName(own)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).repartition("lang", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
