"""Byte-level BPE encoding and decoding as monoid tree reductions.

Encoding: a text is halved until pieces are short, pieces are encoded, and neighbours are joined up the tree. A join keeps
the tokens outside a window around the border and encodes the window again. The window grows on either side until it ends
at a cut: a place between a character that is no white space and one that is. No pre-token spans such a place, and what the
pattern matches on one side depends on nothing on the other, so the tokens outside provably are those of the joined text.
If a side has no cut, the window takes all of it. Decoding: byte strings of pieces of the ids are concatenated up a tree.

Cases: a null or empty text has no ids; special strings are ordinary text; repeated rows each get a row; extra columns are
ignored; an empty table gives no rows. Whole texts are encoded; a text without white space is one window at last, which the
leaf encoder handles. Leaves and windows are encoded by the rank library; what is longer than a leaf, as most documents are,
goes through the tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty, text_slices

#: Characters of a leaf, at most, and of the first window on either side of a border.
LEAF, WINDOW = 512, 64
CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")


class TreeCodec:
    """Encodes and decodes with a file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window = leaf, window
        self.spelling = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.spelling[i] = token
        self.lengths = np.fromiter(map(len, self.spelling), dtype=np.int64, count=len(self.spelling))

    def leaf_ids(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=())

    def _tail_cut(self, text: str, lo: int, mid: int) -> int:
        """The last cut of text[lo:mid] in a window that doubles until it has one; lo if there is none."""
        size = self.window
        while True:
            start = max(lo, mid - size)
            cuts = [m.start() for m in CUT.finditer(text, start + 1 if start == lo else start, mid)]
            if cuts:
                return cuts[-1]
            if start == lo:
                return lo
            size *= 2

    def _head_cut(self, text: str, mid: int, hi: int) -> int:
        """The first cut of text[mid:hi]; hi if there is none."""
        size = self.window
        while True:
            stop = min(hi, mid + size)
            found = CUT.search(text, mid + 1, stop)
            if found and found.start() < stop:
                return found.start()
            if stop == hi:
                return hi
            size *= 2

    def _dropped(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids spell n_bytes bytes. A cut is a border between ids."""
        if not n_bytes:
            return 0
        spelled, k = 0, 0
        step = 64
        while spelled < n_bytes:
            ends = spelled + np.cumsum(self.lengths[ids[k : k + step]])
            at = int(np.searchsorted(ends, n_bytes))
            if at < len(ends):
                if ends[at] != n_bytes:
                    raise AssertionError("a cut inside a token")
                return k + at + 1
            spelled, k, step = int(ends[-1]), k + len(ends), step * 2
        return k

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b = self._tail_cut(text, lo, mid), self._head_cut(text, mid, hi)
        out = self._dropped(left[::-1], len(text[a:mid].encode()))
        head = self._dropped(right, len(text[mid:b].encode()))
        return np.concatenate([left[: len(left) - out], self.leaf_ids(text[a:b]), right[head:]])

    def encode(self, text: str) -> np.ndarray:
        def over(lo: int, hi: int) -> np.ndarray:
            if hi - lo <= self.leaf:
                return self.leaf_ids(text[lo:hi])
            mid = (lo + hi) // 2
            return self.join(text, lo, mid, hi, over(lo, mid), over(mid, hi))

        return over(0, len(text))

    def decode(self, ids: np.ndarray) -> bytes:
        def over(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf:
                return b"".join(map(self.spelling.__getitem__, ids[lo:hi].tolist()))
            mid = (lo + hi) // 2
            return over(lo, mid) + over(mid, hi)

        return over(0, len(ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def encode_texts(df: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of df. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for part in text_slices(batches, "text"):
            ids = [own.encode(t).astype(np.int32) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[id_column, "ids"])

    rows = df.select(F.col(id_column).cast("long").alias(id_column), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` long, ids array<int>")


def decode_ids(df: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, bytes binary) for every row of df; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [own.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=[id_column, "bytes"])

    return df.select(F.col(id_column).cast("long").alias(id_column), F.col(ids_column).cast("array<int>").alias("ids")).mapInArrow(run, f"`{id_column}` long, bytes binary")


def encode_digests(df: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in text_slices(batches, "text"):
            counts, encoded, decoded = [], [], []
            for text in part.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                encoded.append(sha(",".join(map(str, ids.tolist())).encode()))
                decoded.append(sha(own.decode(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_column).cast("long").alias(id_column), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
