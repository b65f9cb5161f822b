"""What a focused crawl does with fetched pages, as filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import text
from textloom.staging import shared_path


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def crawlable(pages: DataFrame, domains: list[str], deny: str | None = None, visited: DataFrame | None = None) -> DataFrame:
    """Pages of the domains that no denied pattern matches, that are HTML, and whose URL wasn't visited before."""
    out = pages.where(in_domains(F.lower(T.url_host("url")), domains))
    if deny:
        out = out.where(~text("url").rlike(deny))
    if "content_type" in pages.columns:
        out = out.where(F.col("content_type").startswith("text/html"))
    if visited is not None:
        out = out.join(visited.select("url").distinct(), "url", "left_anti")
    return out


def pdf_links(html: Column | str) -> Column:
    """The link targets of a page that name a PDF, as written."""
    links = F.regexp_extract_all(text(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    return F.filter(links, lambda x: x.contains(".pdf"))


def extract_items(pages: DataFrame) -> DataFrame:
    """Crawl items (url, title, content, file_urls) of pages (url, html)."""
    found = pages.withColumns({"title": T.html_title("html"), "content": T.visible_text("html"), "_links": pdf_links("html")})
    return found.select("url", "title", "content", T.joined_urls("url", "_links").alias("file_urls"))


def link_table(pages: DataFrame) -> DataFrame:
    """(url, target) of pages (url, html): each link once, as an absolute URL without fragment."""
    links = F.regexp_extract_all(text("html"), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    found = pages.where("url is not null").select("url", F.explode(T.joined_urls("url", links)).alias("target"))
    return found.select("url", F.regexp_replace("target", "#.*$", "").alias("target")).where("target <> ''").distinct()


def follow(links: DataFrame, seeds: DataFrame, max_depth: int, visited: DataFrame | None = None, allowed: Column | None = None) -> DataFrame:
    """(url, depth, parent): what a crawl from seeds (url) comes to by links (url, target), breadth first, each URL once.

    A round joins the last round's URLs to their links and drops what was met before; its rows are a part, by depth, of one
    written table, which is the visited set of the next. So a round's plan does not grow, links that many pages have are counted
    down before they are shuffled, and a lost executor costs its tasks only. The parent is the least of the URLs of the round
    before that link to it; seeds have none.

    visited: (url) of earlier crawls, whose pages are not taken nor followed. allowed: a condition on `url`. Null URLs and null
    targets are left out; a crawl ends where a round finds nothing new, or at max_depth.
    """
    spark = links.sparkSession
    at = shared_path(spark, "frontier")
    schema = "url string, parent string, depth int"
    links = links.select(F.col("url").alias("parent"), F.col("target").alias("url")).where("url is not null and parent is not null")

    def new(rows: DataFrame, depth: int, known: DataFrame | None) -> DataFrame:
        for old in (visited, known):
            if old is not None:
                rows = rows.join(old.select("url"), "url", "left_anti")
        rows = rows if allowed is None else rows.where(allowed)
        rows.select("url", "parent").write.parquet(f"{at}/depth={depth}")
        return spark.read.schema(schema).parquet(at)

    found = new(seeds.select("url").where("url is not null").distinct().withColumn("parent", F.lit(None).cast("string")), 0, None)
    for depth in range(1, max_depth + 1):
        last = found.where(F.col("depth") == depth - 1)
        if last.isEmpty():
            break
        found = new(links.join(last.select(F.col("url").alias("parent")), "parent").groupBy("url").agg(F.min("parent").alias("parent")), depth, found)
    return found.select("url", "depth", "parent")
