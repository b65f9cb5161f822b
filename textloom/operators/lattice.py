"""Segmentation by a word lattice: of all ways to cut a run of letters into known words, the cheapest.

A word's cost is the negative logarithm of its share among the words that were learned; a letter that begins no chosen word
stands alone at the cost of a word seen less than once. The cheapest path is found from the run's end to its start. As for a
search index, a word of more than two letters brings the known words of two and three letters inside it along.

Many runs are searched side by side: a step takes one letter of each, counted from its end, and numpy adds the costs of the
words that begin there. What begins at a letter is looked up in a tree of the words, kept as a table of (node, letter).

The words are counted over the whole corpus by Spark; the most frequent, at most WORDS, are the vocabulary that each task gets.

Cases: null words and texts count for nothing; equally cheap paths go to the longer first word; without any word each letter
stands alone; a text without runs has no segments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.tokens import CJK_SPAN, Segmenter

#: Words of a vocabulary, at most, and letters of one; what a letter counts that is no word; inner words that a search wants.
WORDS, LONGEST, UNSEEN, INNER = 200_000, 24, 0.5, (2, 3)
#: Characters of the texts that a task holds the words of at a time, about, and of those that it searches side by side.
SLICE, GROUP = 1 << 18, 1 << 23
#: Runs that are left at which they are searched one by one; numbers of a table of costs; what spreads keys over a table's places.
NARROW, CELLS, SPREAD = 8, 1 << 21, np.uint64(0x9E3779B97F4A7C15)


class Tree:
    """Words as a tree: a node for each beginning (0: none), and the cost of the word that ends there, or infinity."""

    def __init__(self, words: list[str], costs: list[float]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.depth = int(sizes.max(initial=1))
        codes = np.frombuffer("".join(w.ljust(self.depth, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), self.depth)
        letters = np.unique(codes)
        self.index = np.zeros(0x110000, dtype=np.int32)
        self.index[letters] = np.arange(1, len(letters) + 1)
        self.n = len(letters) + 1
        node, at, keys, known = np.zeros(len(words), dtype=np.int64), np.arange(len(words)), [], 1
        ends = np.zeros(len(words), dtype=np.int64)
        for k in range(self.depth):
            at = at[sizes[at] > k]
            new, which = np.unique(node[at] * self.n + self.index[codes[at, k]], return_inverse=True)
            node[at] = known + which
            ends[at] = node[at]
            keys.append(new)
            known += len(new)
        self.cost = np.full(known, np.inf)
        self.cost[ends[sizes > 0]] = np.asarray(costs)[sizes > 0]
        # nodes by key, in a table with open places; a key is never 0, as letters are counted from 1
        keys = np.concatenate(keys)
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        values, place = np.arange(1, known, dtype=np.int32), self._places(keys)
        while len(keys):
            free = self.keys[place] == 0
            self.keys[place[free]] = keys[free]
            own = self.keys[place] == keys
            self.nodes[place[own]] = values[own]
            keys, values, place = keys[~own], values[~own], (place[~own] + 1) & self.mask

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def next(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that letters (numbers from 1) lead to from nodes, or 0."""
        keys = nodes.astype(np.int64) * self.n + letters
        place = self._places(keys)
        met = self.keys[place]
        out = np.where(met == keys, self.nodes[place], 0)
        left = np.flatnonzero((met != keys) & (met != 0))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            met = self.keys[place[left]]
            fit = met == keys[left]
            out[left[fit]] = self.nodes[place[left[fit]]]
            left = left[~fit & (met != 0)]
        return out


class Lattice:
    """Words with their costs. Beginnings of words that are none themselves are in the same table, with the cost None."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = math.log(max(sum(counts.values()), 1))
        self.unseen = self.total - math.log(UNSEEN)
        self.longest = max(map(len, counts), default=1)

    @cached_property
    def cost(self) -> dict[str, float | None]:
        counts = self.counts
        cost: dict[str, float | None] = {w: self.total - math.log(n) for w, n in counts.items()}
        for w in counts:
            for i in range(len(w) - 1, 0, -1):
                if w[:i] in cost:  # a word's or a beginning's own beginnings come by it
                    if w[:i] not in counts:
                        break
                else:
                    cost[w[:i]] = None
        return cost

    @cached_property
    def tree(self) -> Tree:
        return Tree(list(self.counts), [self.total - math.log(n) for n in self.counts.values()])

    def __reduce__(self):
        return Lattice, (self.counts,)

    @classmethod
    def learn(cls, words: DataFrame, least: int = 2, most: int = WORDS) -> Lattice:
        """From the words (word) of a corpus: those that occur `least` times, the `most` most frequent of them."""
        counts = words.where(F.length("word").between(1, LONGEST)).groupBy("word").count().where(F.col("count") >= least)
        return cls({r["word"]: r["count"] for r in counts.orderBy(F.desc("count"), "word").limit(most).collect()})

    def path(self, run: str) -> list[str]:
        """The words of the cheapest path."""
        return cut_at(run, self._walk(run, [0.0]))

    def _walk(self, run: str, tail: list[float]) -> list[int]:
        """The length of the best word at each letter of a run before those whose paths cost `tail`, the run's end included."""
        n, cost = len(run), self.cost
        start = n - len(tail) + 1
        best, step = [0.0] * start + tail, [1] * start
        for i in range(start - 1, -1, -1):
            own = cost.get(run[i])
            found, size = (self.unseen if own is None else own) + best[i + 1], 1
            for j in range(i + 2, min(n, i + self.longest) + 1):
                own = cost.get(run[i:j], False)
                if own is False:  # nothing begins so
                    break
                if own is not None and own + best[j] <= found:
                    found, size = own + best[j], j - i
            best[i], step[i] = found, size
        return step

    def paths(self, runs: list[str]) -> list[np.ndarray]:
        """The lengths of the best words at each letter of runs, as path() finds them."""
        if len(runs) < NARROW:
            return [np.array(self._walk(r, [0.0]), dtype=np.int32) for r in runs]
        tree, order = self.tree, sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        deep, sizes = tree.depth, np.array([len(runs[i]) for i in order], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a run's place; a letter that leads nowhere ends it
        letters = tree.index[np.frombuffer("".join(runs[i] + "\0" for i in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        letters[first + sizes] = 0
        steps = np.ones(len(letters), dtype=np.int32)
        tail = np.full((deep, len(runs)), np.inf)  # of the letters before, counted from the end, the costs of their paths
        tail[-1] = 0.0
        done, wide = 0, int((sizes > 0).sum())
        while wide >= NARROW:
            high = int(min(max(1, CELLS // (deep * wide)), sizes[0] - done))
            own = (first + sizes)[:wide] - done - 1 - np.arange(high)[:, None]
            at = np.flatnonzero(own >= first[:wide])
            place, node = own.ravel()[at], np.zeros(len(at), dtype=np.int32)
            costs = np.full((high, deep, wide), np.inf)
            costs[:, -1] = self.unseen
            flat, row, column = costs.reshape(-1), at // wide, at % wide
            base = row * (deep * wide) + column
            for k in range(deep):
                letter = letters[place + k]
                node = tree.next(node, letter)
                live = np.flatnonzero((node > 0) & (letter > 0))
                place, node, base = place[live], node[live], base[live]
                if not len(live):
                    break
                price = tree.cost[node]
                word = np.flatnonzero(price < np.inf)
                flat[base[word] + (deep - 1 - k) * wide] = price[word]
            best = np.concatenate([tail[:, :wide], np.empty((high, wide))])
            size = np.empty((high, wide), dtype=np.int64)
            for t in range(high):
                both = np.add(costs[t], best[t : t + deep], out=costs[t])
                both.argmin(axis=0, out=size[t])  # the first is the longest
                both.min(axis=0, out=best[t + deep])
            steps[own.ravel()[at]] = deep - size.ravel()[at]
            tail, done = best[-deep:], done + high
            wide = int((sizes > done).sum())
        out = [steps[:0]] * len(runs)
        for r, i in enumerate(order):
            found = steps[first[r] : first[r] + sizes[r]]
            if r < wide:
                known = tail[::-1, r][: min(deep, done + 1)].tolist()
                found[: sizes[r] - done] = self._walk(runs[i], known + [math.inf] * (done + 1 - len(known)))
            out[i] = found
        return out

    def inner(self, word: str) -> list[str]:
        """The known short words inside a word, by length and place, then the word."""
        return [word[i : i + k] for k in INNER if len(word) > k for i in range(len(word) - k + 1) if word[i : i + k] in self.counts] + [word]

    def segments(self, texts: pd.Series, span: re.Pattern, search: bool) -> Iterator[pd.Series]:
        """The words of texts, a slice at a time, as a text's words take many times its own memory."""
        for group in slices(texts, GROUP):
            runs = [span.findall(t or "") for t in group]
            steps = iter(self.paths([r for own in runs for r in own]))
            words = pd.Series([[(r, next(steps)) for r in own] for own in runs], index=group.index, dtype=object)
            for part in slices(group):
                cut = ([w for r, sizes in words[i] for w in cut_at(r, sizes.tolist())] for i in part.index)
                yield pd.Series([[x for w in ws for x in self.inner(w)] for ws in cut] if search else list(cut), index=part.index, dtype=object)

    def segmenter(self, span: str = CJK_SPAN, search: bool = True) -> Segmenter:
        """A segmenter of the runs that `span` matches. search: inner words too."""
        @F.pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield from self.segments(texts, re.compile(span), search)

        return lambda x: run(x)


def cut_at(run: str, sizes: list[int]) -> list[str]:
    """The words of a run, from the length of the best one at each letter."""
    out, at = [], 0
    while at < len(run):
        out.append(run[at : at + sizes[at]])
        at += sizes[at]
    return out


def slices(texts: pd.Series, size: int | None = None) -> Iterator[pd.Series]:
    """Parts of a batch that end when they have so many characters, or SLICE."""
    size, start, held = size or SLICE, 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t or "")
        if held >= size or i == len(texts):
            yield texts.iloc[start:i]
            start, held = i, 0


def unspaced(text: Column) -> Column:
    """A text's letters in lower case, without anything between them."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))


def words_of(text: Column) -> Column:
    """A text's runs of letters in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")
