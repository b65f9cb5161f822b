"""Best-fit packing by minimum bin slack.

Documents are token ids and an end id. Longer ones than a sequence are cut; only their first piece may be shorter. Pieces
go to groups of bounded size. In a group, a bin takes the longest piece that is left; a bitset subset-sum over the
other available lengths finds the combination that fills it most, which is then removed.

Cases: a null or empty text is a document of the end id alone; special strings in a text become their special id, as in the
tokenizers file of the same vocabulary; repeated rows are packed each; extra columns are ignored; an empty table gives no
rows; pieces of equal length are packed in the order they come, whichever they are.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stage, text_or_empty, text_slices

#: Pieces of a group, about.
GROUP = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_path: str):
    """The vocabulary of a byte-level tokenizers file (or of a file of ranks) in the faster library; ids are the same."""
    import json

    import tiktoken

    from textloom.llm.token_counts import byte_letters

    if tokenizer_path.endswith(".tiktoken"):
        with open(tokenizer_path, "rb") as f:
            return tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a byte-level BPE file without normalizer and prefix space")
    back = {c: b for b, c in byte_letters().items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    made = [spec["model"]["vocab"][a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError("ids don't follow the order of merges, so they are no ranks")
    ranks = {bytes(map(back.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(s, (first if not s else capacity)) for s in starts]


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document of df (doc_id, text): doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        special = own.special_tokens_set
        end = np.array([end_id], dtype="<u4")
        for part in text_slices(batches, "text"):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.concatenate([own.encode_to_numpy(text, allowed_special=special), end]).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            doc, k, s, n, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def fill(counts: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """The lengths whose sum fills room most, at most counts[n] of each n. lengths: those in stock, longest first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    full = 1 << room
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(int(counts[n]), room // n)):
            more = (reach | (reach << n)) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
            if reach & full:
                break
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if at and not (before >> at) & 1:
            taken.append(n)
            at -= n
    return taken


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths.tolist()):
        stock[n].append(i)
    counts = np.array([len(x) for x in stock])
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    sizes, b = [int(n) for n in np.flatnonzero(counts)[::-1]], 0
    while sizes:
        longest = sizes[0]
        counts[longest] -= 1
        taken, at = [longest, *fill(counts, sizes, capacity - longest)], 0
        for n in taken[1:]:
            counts[n] -= 1
        for n in taken:
            i = stock[n].pop()
            bins[i], offsets[i] = b, at
            at += n
        b += 1
        if any(not counts[n] for n in taken):
            sizes = [n for n in sizes if counts[n]]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length (1 to capacity). Groups are dealt evenly, whatever the keys."""
    pieces = stage(pieces, "pieces")
    groups = max(1, math.ceil(pieces.count() / group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if got:
            own = pa.Table.from_batches(got)
            bins, offsets = minimum_bin_slack(own.column("length").to_numpy(), capacity)
            own = own.append_column("sequence_id", pa.array(bins + (np.int64(TaskContext.get().partitionId()) << 32)))
            yield from own.append_column("offset", pa.array(offsets)).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(groups).mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(df, tokenizer_path, capacity, end_id), capacity)
