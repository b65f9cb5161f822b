"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Trees are grown from histograms of a bounded sample of distinct labelled urls, whose features one job computes and brings to
the driver; there each level of a tree is a few array sums. The model is a sum of CASE expressions and a table of suffix
statistics that is joined by broadcast, with at most a row for each sampled url, so scoring is one pass over the pages without
shuffle. Only DataFrame and SQL functions are used on the pages.

A suffix's statistic is the share of blocked urls under it, drawn to one half. In training, a url's is taken from the hosts of
other folds, so that it says no more than it would of a host never seen; classes weigh the same. So an unknown url without
odd features scores about one half.

Cases: a null url, or one without "://", has an empty host and path, fits no rule, and is scored on what its characters are;
of rules that fit, the longest wins; of repeated labelled urls, one counts, or one for each of its labels; without labelled
rows every url is allowed, and with labels of one kind only every url gets it; repeated rows each get a row; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct labelled urls that a model is trained on, at most, of the smallest hashes.
TRAIN_ROWS = 20_000
#: Features, in the order of the trees' columns. The last comes from statistics.
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "suffix_rate")
BINS, FOLDS, SMOOTHING = 32, 5, 20


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and the paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits; null if none does."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        out = (F if out is None else out).when(rule.fits(host, path), F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need no statistics to df (url, host, path), and the host's suffix."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u)
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    return df.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "labels": F.size(F.split("host", "\\.")).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(F.length(u) - F.length(F.translate(u, "0123456789", "")), n), F.lit(0.0)).cast("double"),
            "entropy": F.when(n > 0, F.round(entropy, 9)).otherwise(0.0),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))).cast("double"),
            "suffix": F.regexp_extract("host", "([^.]*)$", 1),
        }
    )


@dataclass
class BoostedTrees:
    """A sum of trees over named features. A tree is a dict of node number (root 1, children 2n and 2n + 1) to
    (feature, threshold) or to a leaf value. rates: the statistic of each suffix."""

    base: float
    rates: dict[str, float] = field(default_factory=dict)
    trees: list[dict[int, tuple[str, float] | float]] = field(default_factory=list)

    def with_rates(self, df: DataFrame) -> DataFrame:
        known = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(self.rates)), "map<string,double>")).alias("suffix", "suffix_rate"))
        return df.join(F.broadcast(known), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.5)))

    def _value(self, tree: dict, node: int = 1) -> Column:
        own = tree[node]
        if isinstance(own, float):
            return F.lit(own)
        return F.when(F.col(own[0]) <= own[1], self._value(tree, 2 * node)).otherwise(self._value(tree, 2 * node + 1))

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + self._value(tree)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def suffix_rates(suffix: np.ndarray, blocked: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """The share of blocked weight under each suffix, drawn to one half."""
    names, at = np.unique(suffix, return_inverse=True)
    total, bad = np.bincount(at, weight), np.bincount(at, weight * blocked)
    return dict(zip(names.tolist(), ((bad + SMOOTHING / 2) / (total + SMOOTHING)).tolist(), strict=True))


def best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, border) of the best split of a node's histogram sums (feature, bin)."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    gain = np.where(np.minimum(left_h, all_h - left_h) < 1e-3, 0, np.round(gain, 6))
    f, k = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, k]), int(f), int(k)


def grow(bins: np.ndarray, borders: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> tuple[dict, np.ndarray]:
    """A tree for rows of bin numbers (row, feature) with gradients g and weights h, and its value for each row."""
    tree: dict = {}
    node = np.ones(len(bins), dtype=np.int64)
    open_ = [1]
    for level in range(depth + 1):
        for n in open_:
            rows = np.flatnonzero(node == n)
            tree[n] = round(float(rate * g[rows].sum() / (h[rows].sum() + ridge)), 9)
            if level == depth or not len(rows):
                continue
            sums = [np.stack([np.bincount(bins[rows, f], x[rows], minlength=BINS) for f in range(bins.shape[1])]) for x in (g, h)]
            gain, f, k = best_split(*sums, ridge)
            if gain > 1e-6 and k < len(borders[f]):
                tree[n] = (FEATURES[f], float(borders[f][k]))
                node[rows] = 2 * n + (bins[rows, f] > k)
        open_ = [c for n in open_ if isinstance(tree[n], tuple) for c in (2 * n, 2 * n + 1)]
    return tree, np.array([tree[n] for n in node.tolist()])


def train(labelled: DataFrame, rounds: int = 12, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Trees for labelled urls (url, host, path, blocked 0 or 1)."""
    some = labelled.where("blocked is not null").select("url", "host", "path", "blocked").distinct()
    some = lexical(some.orderBy(F.xxhash64("url"), "url", "blocked").limit(rows))
    got = some.select("blocked", "suffix", (F.crc32("host") % FOLDS).alias("fold"), *FEATURES[:-1]).collect()  # at most `rows`
    if not got:
        return BoostedTrees(-10.0)
    blocked = np.array([r["blocked"] for r in got], dtype=np.float64)
    if blocked.min() == blocked.max():
        return BoostedTrees(10.0 if blocked[0] else -10.0)
    suffix, fold = np.array([r["suffix"] for r in got], dtype=np.str_), np.array([r["fold"] for r in got])
    share = blocked.mean()
    weight = np.where(blocked == 1, 0.5 / share, 0.5 / (1 - share))
    known = np.empty(len(got))
    for k in range(FOLDS):
        own = fold == k
        of_others = suffix_rates(suffix[~own], blocked[~own], weight[~own])
        known[own] = [of_others.get(x, 0.5) for x in suffix[own].tolist()]
    x = np.column_stack([*(np.array([r[f] for r in got]) for f in FEATURES[:-1]), known])
    borders = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(len(FEATURES))]
    bins = np.column_stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(borders)])  # how many borders are below
    model = BoostedTrees(0.0, suffix_rates(suffix, blocked, weight))
    margin = np.zeros(len(got))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree, value = grow(bins, borders, weight * (blocked - p), weight * p * (1 - p), depth, rate, ridge)
        margin += value
        model.trees.append(tree)
    return model


def filter_urls(pages: DataFrame, rules: list[Rule], model: BoostedTrees | None = None, id_column: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row. Without a model, one is trained on the urls that fit rules."""
    host, path = parsed(F.col("url"))
    rows = pages.select(F.col(id_column).cast("long").alias(id_column), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumns({"rule": matched(rules, F.col("host"), F.col("path"), lambda r: r.name), "ruled": matched(rules, F.col("host"), F.col("path"), lambda r: r.verdict)})
    if model is None:
        model = train(rows.where("ruled is not null").withColumn("blocked", (F.col("ruled") == BLOCK).cast("int")))
    scored = model.with_rates(lexical(rows)).withColumn("score", model.probability())
    return scored.select(id_column, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
