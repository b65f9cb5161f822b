"""Cleaning, URLs and identifiers, as columns."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textloom.functions.columns import WS, col, contains_any, first_full, let, strip, text

# Lines that are navigation, beginnings and endings of boilerplate lines. Those that name a site come from the
# caller.
NAVIGATION_LINES = [
    "English", "中文", "学校首页", "学校主页", "首页", "首 页", "导航", "返回", "当前位置：", "更多+", "更多", "Home", "About US", "About",
    "Research", "People", "Academics", "News", "Events", "学校官微", "学院官微",
]
BOILERPLATE_STARTS = ["Copyright ©", "沪公网安备", "地址：", "当前位置："]
BOILERPLATE_END = "更多+"
RULE_LINE = r"\A[|·•—\-_=+*/\\]+\z"
# What a text with collapsed white space doesn't have.
COLLAPSED = ["\r", "\xa0", "\t", "\f", "\x0b", "  ", "\n\n\n"]
# Entities that are replaced without a Python function. The ampersand comes last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": "\xa0", "&copy;": "©",
    "&reg;": "®", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&amp;": "&",
}


def collapse_whitespace(x: Column | str) -> Column:
    """Line ends as LF, runs of blanks as one, at most one empty line, no white space at the ends. Texts that are so already,
    as those of a second pass, are only looked at."""

    def collapsed(v: Column) -> Column:
        out = F.regexp_replace(v, r"\r\n?", "\n")
        out = F.replace(out, F.lit("\xa0"), F.lit(" "))
        out = F.regexp_replace(out, r"[ \t\f\x0b]{2,}|[\t\f\x0b]", " ")  # a single blank stays as it is
        return F.regexp_replace(out, r"\n{3,}", "\n\n")

    return strip(let(text(x), lambda v: F.when(contains_any(v, COLLAPSED), collapsed(v)).otherwise(v)))


@F.pandas_udf(StringType())
def unescape_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every entity that HTML knows."""
    for xs in batches:
        yield xs.map(html.unescape, na_action="ignore")


def unescape_common(x: Column | str) -> Column:
    def replaced(v: Column) -> Column:
        out = v
        for entity, char in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
        return out

    return let(col(x), lambda v: F.when(v.contains("&"), replaced(v)).otherwise(v))


def drop_elements(x: Column | str, compat: bool = False) -> Column:
    """Without script, style and noscript elements; compat keeps their bodies, as an old defect did."""
    return text(x) if compat else F.regexp_replace(text(x), r"(?is)<(script|style|noscript)\b.*?>.*?</\1>", " ")


def strip_html(x: Column | str, all_entities: bool = False, compat: bool = False) -> Column:
    """Tags as line ends, entities as characters, white space collapsed."""
    out = F.regexp_replace(drop_elements(x, compat), r"(?s)<[^>]+>", "\n")
    return collapse_whitespace(unescape_all(out) if all_entities else unescape_common(out))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(StringType())
def parsed_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text nodes of HTML, by a parser, joined by line ends."""

    def one(x: str) -> str:
        parser = _Text()
        parser.feed(x)
        parser.close()
        return "\n".join(parser.parts)

    for xs in batches:
        yield xs.map(one, na_action="ignore")


def html_text(x: Column | str, parser: bool = False) -> Column:
    """The text of an HTML file: by pattern, or by a parser. Blanks around line ends go."""
    out = parsed_text(text(x)) if parser else unescape_common(F.regexp_replace(drop_elements(x), r"(?s)<[^>]+>", "\n"))
    return collapse_whitespace(F.regexp_replace(F.regexp_replace(out, r"[ \t\f\x0b]+\n", "\n"), r"\n[ \t\f\x0b]+", "\n"))


def html_title(x: Column | str) -> Column:
    return strip(unescape_common(F.regexp_extract(text(x), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def visible_text(x: Column | str) -> Column:
    """The text nodes of a page's body without scripts and styles, stripped, joined by spaces."""
    body = F.regexp_extract(text(x), r"(?is)<body\b[^>]*>(.*)", 1)
    bare = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?>.*?</\1>", "\x00"), r"(?s)<!--.*?-->", "\x00")
    nodes = F.split(F.regexp_replace(bare, r"(?s)<[^>]+>", "\x00"), "\x00")
    return F.array_join(F.filter(F.transform(nodes, lambda n: strip(unescape_common(n))), lambda n: n != ""), " ")


def boilerplate(line: Column, site_lines: list[str] | None = None) -> Column:
    """Whether a stripped line says nothing of its own."""
    out = (F.length(line) <= 1) | line.isin(NAVIGATION_LINES + (site_lines or [])) | line.endswith(BOILERPLATE_END) | line.rlike(RULE_LINE)
    for start in BOILERPLATE_STARTS:
        out = out | line.startswith(start)
    return out | ((F.length(line) <= 2) & ~line.rlike("[一-鿿A-Za-z0-9]"))


def without_repeats(xs: Column) -> Column:
    """Consecutive equal items as one."""
    return let(xs, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def clean_lines(x: Column, site_lines: list[str] | None = None) -> Column:
    """The lines of a text that aren't boilerplate, without consecutive repeats."""
    lines = F.transform(F.split(x, "\n"), strip)
    return collapse_whitespace(F.array_join(without_repeats(F.filter(lines, lambda n: ~boilerplate(n, site_lines))), "\n"))


def clean_text(x: Column | str, site_lines: list[str] | None = None, all_entities: bool = False) -> Column:
    return clean_lines(strip_html(x, all_entities), site_lines)


def url_host(x: Column | str) -> Column:
    """The network location of a URL; null if it has none."""
    return F.nullif(F.regexp_extract(col(x), r"^(?:[^:/?#]+:)?//([^/?#]*)", 1), F.lit(""))


def content_sha256(x: Column | str) -> Column:
    return F.when(text(x) != "", F.sha2(col(x), 256))


def date_prefix(x: Column | str) -> Column:
    return F.when(text(x) != "", F.split_part(col(x), F.lit("T"), F.lit(1)))


def slashes(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("\\"), F.lit("/"))


def percent_decoded(x: Column | str) -> Column:
    """Percent escapes as characters. A plus and a lone percent sign stay."""
    kept = F.replace(F.regexp_replace(col(x), "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(kept)


def canonical_url(x: Column | str) -> Column:
    """A page's URL without what mirrors differ in: case, template folder, doubled slashes, index pages, query, fragment.
    Redirect pages keep their article's number. Null or empty: empty."""
    url = percent_decoded(strip(text(x)))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"^[^?#]*", 0)
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)/_t\d+/", "/"), "/+", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/+\z", ""), r"(?i)/main\.(?:htm|psp)\z", "")
    path = F.regexp_replace(path, r"(?i)/list\d*\.htm\z", "/list.htm")
    article = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*\?(?:[^#]*&)?articleId=([^&#]+)", 1), r"\+", " ")
    tail = F.when(path.contains("_redirect"), F.concat(F.lit("?articleId="), article)).otherwise("")
    return F.when(text(x) == "", "").otherwise(F.concat(scheme, F.lit("://"), host, path, tail))


def chunk_id_parts(x: Column | str) -> tuple[Column, Column]:
    """(document id, chunk index) of a chunk id; nulls if it isn't two whole numbers."""
    part = lambda i: F.nullif(F.regexp_extract(text(x), r"\A(\d+)-(\d+)\z", i), F.lit("")).try_cast("bigint")
    return part(1), part(2)


def signature(x: Column | str) -> Column:
    """The first 120 characters of a text in lower case without URLs and white space."""
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(text(x), rf"https?://[^\s\x1c-\x1f\x85\p{{Z}}]+", ""), f"{WS}+", "")), 1, 120)


def chunk_header(title: Column | str, url: Column | str, body: Column | str) -> Column:
    return strip(F.concat(text(title), F.lit("\n"), text(url), F.lit("\n\n"), text(body)))


def haystack(title: Column | str, url: Column | str, body: Column | str) -> Column:
    return F.lower(F.concat_ws("\n", text(title), text(url), text(body)))


def snippet(x: Column | str, width: int = 300) -> Column:
    flat = F.replace(strip(text(x)), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)


def after_thinking(x: Column | str) -> Column:
    """What follows the first closing tag of a model's thoughts, stripped; the whole text without one."""
    mark = "</think>"
    at = F.locate(mark, text(x))
    return strip(F.when(at > 0, F.substring(text(x), at + len(mark), F.length(text(x)))).otherwise(text(x)))


def file_name(x: Column | str) -> Column:
    """The decoded last part of a URL's path."""
    return percent_decoded(F.regexp_extract(F.regexp_extract(text(x), r"^[^?#]*", 0), "[^/]*$", 0))


@F.pandas_udf(ArrayType(StringType()))
def joined_urls(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links of a page as absolute URLs."""
    return pd.Series([[urljoin(b or "", x) for x in (xs if xs is not None else [])] for b, xs in zip(base, links, strict=True)])


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for xs in batches:
        yield xs.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def named(*choices: Column | str, default: str = "") -> Column:
    return F.coalesce(first_full(*choices), F.lit(default))
