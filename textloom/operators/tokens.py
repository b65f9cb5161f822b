"""Tokens for sparse retrieval, as columns: exact entities, ASCII runs, segmenter words and CJK n-grams, with repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.columns import WS, col, let, strip, text
from textloom.functions.text import nfkc

# What a token is, and words that are none. A site's own names are stopwords that the caller adds.
URL = rf"https?://[^\s\x1c-\x1f\x85\p{{Z}}，。；、)）>]+"
EMAIL = r"[a-z0-9_.+-]+@[a-z0-9.-]+"
TITLE = r"《([^》]{2,40})》"
ASCII_RUN = r"[a-z0-9][a-z0-9_.@%+-]*"
CJK_SPAN = r"[一-鿿]+"
STOPWORDS = [
    "的", "了", "是", "在", "和", "与", "及", "或", "也", "有", "无", "为",
    "什么", "哪些", "哪个", "多少", "几个", "是否", "有没有", "一共", "目前",
    "当前", "最新", "最近", "信息学院", "科技", "大学",
]

#: A segmenter maps a column of normalised texts to one of word arrays, for instance by a pandas UDF.
Segmenter = Callable[[Column], Column]


def all_of(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def ngrams(span: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams of a text, shorter ones first."""

    def of(n: int) -> Column:
        starts = F.when(F.length(span) >= n, F.sequence(F.lit(1), F.length(span) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(span, i, F.lit(n)))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def cjk_ngrams(x: Column | str, low: int = 2, high: int = 4) -> Column:
    """The n-grams of each run of CJK letters."""
    return F.flatten(F.transform(all_of(col(x), CJK_SPAN), lambda s: ngrams(s, low, high)))


def dictionary_segmenter(words: list[str]) -> Segmenter:
    """A segmenter by longest match from the left over a word list. CJK letters that begin no word stand alone."""
    known = sorted({w.lower() for w in words}, key=lambda w: (-len(w), w))
    pattern = "|".join([*("\\Q" + w.replace("\\E", "") + "\\E" for w in known), "[一-鿿]"])
    return lambda x: F.when(x.rlike("[一-鿿]"), all_of(x, pattern)).otherwise(F.array().cast("array<string>"))


def tokenize(x: Column | str, segmenter: Segmenter | None = None, stopwords: list[str] | None = None, compatible: bool = True) -> Column:
    """Tokens of a text, of two characters at least. compatible: fold compatibility forms first, by a Python function.

    A pattern is tried only in texts that have what it needs; runs of ASCII are held against the stopwords only if some of
    those are such runs.
    """
    low = F.lower(nfkc(text(x)) if compatible else text(x))
    words = segmenter(low) if segmenter else F.array().cast("array<string>")
    stop = STOPWORDS + (stopwords or [])
    plain_stop = [w for w in stop if w.isascii()]
    wanted = lambda ts: F.filter(ts, lambda t: (F.length(t) > 1) & ~t.isin(stop))
    if_ = lambda need, ts: F.when(need, ts).otherwise(F.array().cast("array<string>"))

    def found(v: Column, w: Column) -> Column:
        runs = all_of(v, ASCII_RUN[:-1] + "+")  # of two characters at least
        urls, emails = if_(v.contains("http"), all_of(v, URL)), if_(v.contains("@"), all_of(v, EMAIL))
        titles = if_(v.contains("《"), F.transform(all_of(v, TITLE, 1), strip))
        grams = if_(v.rlike("[一-鿿]"), cjk_ngrams(v))
        if plain_stop:
            urls, emails, runs = (F.filter(ts, lambda t: ~t.isin(plain_stop)) for ts in (urls, emails, runs))
        return F.concat(urls, emails, wanted(titles), runs, wanted(F.transform(w, strip)), wanted(grams))

    return let(F.struct(low.alias("v"), words.alias("w")), lambda s: found(s["v"], s["w"]))


def blank_split(x: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(text(x), f"{WS}+"), lambda w: w != "")
