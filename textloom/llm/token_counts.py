"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a slice of texts are held as one ragged numpy array of symbols. A round finds each sequence's
lowest-rank adjacent pair and merges all its occurrences at once; the symbols that survive are the tokens. The merge list
is checked when it is loaded: a merge must come after the merges that make its parts, so that a merge can't create a pair
that should have gone first, and a round equals the one-pair-at-a-time order.

Cases: a null or empty text has 0 tokens; special strings inside a text count one token each, as the library counts them;
repeated rows each get a row; extra columns are ignored; an empty table gives no rows. Whole texts are counted, whatever their
length.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty, text_slices

#: Words whose counts a worker keeps, at most; beyond, it forgets them all.
CACHE_WORDS = 300_000
#: Texts of these characters only are split here; others go through the library's own normalizer and splitter, whose
#: Unicode tables may be newer than Python's.
COMMON = re.compile("[^\\x00-\\u052f\\u2000-\\u206f\\u3000-\\u30ff\\u4e00-\\u9fff\\uff00-\\uffef]")
NONE = np.int64(1 << 40)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class RankMerger:
    """Counts the BPE symbols of byte strings for a merge list with a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges)]
        made = {ab: rank for rank, (*_, ab) in enumerate(pairs)}  # the last merge that makes a symbol
        if any(max(made.get(a, -1), made.get(b, -1)) >= rank for rank, (a, b, _) in enumerate(pairs)):
            raise ValueError("a merge comes before the merges of its parts")
        keys = np.array([a * int(self.width) + b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.products = np.array([ab for *_, ab in pairs], dtype=np.int64)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word; an empty word has none."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = sizes.copy()
        if not sizes.sum():
            return counts
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        last = np.ones(len(raw), dtype=bool)
        last[:-1] = owner[1:] != owner[:-1]
        symbols = np.where(last, self.final[raw], self.inner[raw])
        ranks = np.full(len(raw), NONE)  # of the pair that begins here
        open_ = np.flatnonzero(~last)
        ranks[open_] = self.rank(symbols[open_], symbols[open_ + 1])
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(owner)])
            live = lowest < NONE
            done = ~live
            counts[owner[starts[done]]] = lengths[done]
            if not live.any():
                return counts
            if done.any():
                keep = np.repeat(live, lengths)
                symbols, ranks, owner = symbols[keep], ranks[keep], owner[keep]
                lowest, lengths = lowest[live], lengths[live]
            mark = ranks == np.repeat(lowest, lengths)
            at = np.flatnonzero(mark)
            if len(at) > 1:  # of overlapping occurrences, as in "aaa", every second one from the left
                run_start = np.r_[True, at[1:] != at[:-1] + 1]
                offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
                at = at[offset % 2 == 0]
            symbols[at] = self.products[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            new_at = at - np.arange(len(at))  # where the merged symbols are once their right halves are gone
            symbols, ranks, owner = symbols[keep], ranks[keep], owner[keep]
            stale = np.unique(np.r_[new_at, new_at[new_at > 0] - 1])
            nxt = np.minimum(stale + 1, len(symbols) - 1)
            within = (stale + 1 < len(symbols)) & (owner[nxt] == owner[stale])
            ranks[stale] = np.where(within, self.rank(symbols[stale], symbols[nxt]), NONE)


class WordTokenCounter:
    """Counts tokens of texts for a tokenizers file: NFC, white space, lower case, word pattern, BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a lower-case word BPE file")
        self.merger = RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.words = regex.compile(split["pattern"]["Regex"])
        self.space = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        letters = byte_letters()
        self.letter_bytes = {c: b for b, c in letters.items()}
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if COMMON.search(text):
            lowered = self.library.normalizer.normalize_str(text)
            spelled = (w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(lowered))
            return [bytes(map(self.letter_bytes.__getitem__, w)).decode("utf-8", "surrogateescape") for w in spelled]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no context for a final sigma
        return self.words.findall(self.space.sub(" ", text).lower())

    def counts(self, texts: Iterable[str]) -> list[int]:
        base, words = [], []
        for text in texts:
            if self.special and "<|" in text:
                parts = self.special.split(text)
                base.append(len(parts) - 1)
                words.append([w for part in parts for w in self.split(part)])
            else:
                base.append(0)
                words.append(self.split(text))
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        missing = list(set().union(*words).difference(self.cache))
        for i in range(0, len(missing), 50_000):
            some = missing[i : i + 50_000]
            self.cache.update(zip(some, self.merger.count([w.encode("utf-8", "surrogateescape") for w in some]).tolist(), strict=True))
        return [n + sum(map(self.cache.__getitem__, own)) for n, own in zip(base, words, strict=True)]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> WordTokenCounter:
    return WordTokenCounter(path)


def count_tokens(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of df. No shuffle; state per worker is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for part in text_slices(batches, "text", 2 << 20):
            sizes = pa.compute.binary_length(part.column(1)).cast(pa.int64())
            tokens = pa.array(own.counts(part.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, tokens, pa.compute.greater(tokens, limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_column).cast("long").alias(id_column), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` long, n_bytes long, n_tokens long, over_limit boolean")
