"""Following links against a crawl by hand."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import crawl


def by_hand(links, seeds, depth, visited=(), allowed=lambda u: True):
    found = {u: (0, None) for u in seeds if u not in visited and allowed(u)}
    last = set(found)
    for d in range(1, depth + 1):
        new = {}
        for u, t in sorted(links):
            if u in last and t not in found and t not in visited and allowed(t):
                new[t] = min(new.get(t, u), u)
        found |= {t: (d, u) for t, u in new.items()}
        last = set(new)
    return {u: v for u, v in found.items()}


def crawled(spark, links, seeds, depth, **how):
    rows = crawl.follow(spark.createDataFrame([*links, (None, "x"), ("x", None)], "url string, target string"), spark.createDataFrame([*((u,) for u in seeds), (None,)], "url string"), depth, **how)
    return {r["url"]: (r["depth"], r["parent"]) for r in rows.collect()}, rows.count()


@pytest.mark.parametrize("seed", range(2))
def test_crawls_equal_those_by_hand(spark, seed):
    rng = random.Random(seed)
    links = [(f"u{rng.randrange(120)}", f"u{rng.randrange(120)}") for _ in range(170)] + [("u1", "u1"), ("u2", "u3"), ("u2", "u3")]
    seeds = ["u1", "u2", "u5", "u5"]
    for depth in (0, 3, 50):
        want = by_hand(links, seeds, depth)
        assert crawled(spark, links, seeds, depth) == (want, len(want))
    old = spark.createDataFrame([("u2",), ("u7",), ("u9",)], "url string")
    want = by_hand(links, seeds, 9, {"u2", "u7", "u9"}, lambda u: not u.endswith("4"))
    assert crawled(spark, links, seeds, 9, visited=old, allowed=~F.col("url").endswith("4"))[0] == want


def test_no_seeds(spark):
    assert crawled(spark, [("a", "b")], [], 3) == ({}, 0)


def test_links_of_pages_are_absolute_and_distinct(spark):
    page = "<a href='/d/a'>x</a><a HREF=b?q=1#top>y</a><a href=\"../c\">z</a><a href='//o.example/x'>w</a><a href='b?q=1'>again</a><a href='#here'>h</a>"
    rows = crawl.link_table(spark.createDataFrame([("https://a.example/p/q/", page), (None, page), ("https://b.example/", None)], "url string, html string")).collect()
    assert sorted(r["target"] for r in rows) == ["https://a.example/d/a", "https://a.example/p/c", "https://a.example/p/q/", "https://a.example/p/q/b?q=1", "https://o.example/x"]
