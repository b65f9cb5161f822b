"""Hand-worked rows for cleaning, URLs, dates and chunks."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import safe_int, strip
from textloom.functions.dates import extract_dates
from textloom.operators import chunk, tokens


def one(spark, expr, *values):
    names = "abc"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("  a\r\nb\rc \t d\n\n\n\ne\xa0 ", "a\nb\nc d\n\ne"), ("", ""), (None, ""), ("　x\x1c", "x")])
def test_collapse_whitespace(spark, text, want):
    assert one(spark, T.collapse_whitespace("a"), text) == want


def test_scripts_go_with_their_bodies_unless_compatible(spark):
    page = "<p>a</p><SCRIPT>var x='<p>b</p>'</script><style>c</style>d &amp;lt; &copy;"
    assert one(spark, T.strip_html("a"), page) == "a\n d &lt; ©"
    assert "b" in one(spark, T.strip_html("a", compat=True), page)
    assert one(spark, T.strip_html("a", all_entities=True), "&eacute;&#20013;") == "é中"


def test_parser_and_pattern_agree_on_plain_pages(spark):
    page = "<html><body><h1>T</h1><script>x</script><p>a <b>b</b></p></body></html>"
    assert one(spark, T.html_text("a", parser=True), page).split() == one(spark, T.html_text("a"), page).split() == ["T", "a", "b"]


@pytest.mark.parametrize("line", ["", "首页", "Copyright © X", "沪公网安备 1", "地址：某处", "当前位置：首页", "通知 更多+", "更多", "x", "|—·", "!?", "★☆"])
def test_boilerplate_lines_go(spark, line):
    assert one(spark, T.clean_text("a"), f"keep this\n{line}\nand this") == "keep this\nand this"


def test_only_consecutive_repeats_go(spark):
    assert one(spark, T.clean_text("a"), "aa\naa\nbb\naa") == "aa\nbb\naa"


def test_a_line_of_two_letters_stays_and_site_lines_go(spark):
    assert one(spark, T.clean_text("a", site_lines=["Our Site"]), "ab\nOur Site\n中文字") == "ab\n中文字"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://A.Example.edu/_T335/x//main.htm", "https://a.example.edu/x"),
        ("https://a.example.edu/list12.HTM?a=1#b", "https://a.example.edu/list.htm"),
        ("https://a.example.edu/x/_redirect?siteId=1&articleId=42", "https://a.example.edu/x/_redirect?articleId=42"),
        ("https://a.example.edu/%E4%B8%AD+b/", "https://a.example.edu/中+b"),
        ("https://a.example.edu/100%", "https://a.example.edu/100%"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, T.canonical_url("a"), url) == want


def test_identifiers(spark):
    assert [one(spark, safe_int("a"), x) for x in ("12", " 12 ", "1.5", "x", None)] == [12, 12, 0, 0, 0]
    assert one(spark, F.array(*T.chunk_id_parts("a")), "12-3") == [12, 3]
    assert one(spark, F.array(*T.chunk_id_parts("a")), "12-") == [None, None]


def test_signature_ignores_urls_and_white_space(spark):
    assert one(spark, T.signature("a"), "See HTTP https://x.y/z  NOW\n ok" + "a" * 200) == ("seehttpnowok" + "a" * 200)[:120]


def test_dates_by_pattern_without_invalid_ones(spark):
    got = one(spark, F.transform(extract_dates("a"), lambda d: d.cast("string")), "2025年3月4日 2024.1.5 2025-02-30 2023/12/31")
    assert got == ["2024-01-05", "2023-12-31", "2025-03-04"]


def test_thoughts_names_and_snippets(spark):
    assert one(spark, T.after_thinking("a"), "hm</think> yes ") == "yes"
    assert one(spark, T.after_thinking("a"), " no tag ") == "no tag"
    assert one(spark, T.file_name("a"), "https://x/a/b%20c.pdf?d=/e") == "b c.pdf"
    assert one(spark, T.snippet("a"), "x" * 301) == "x" * 300 + "..."
    assert one(spark, T.joined_urls("a", F.array("b")), "https://x/a/b", "../c.pdf") == ["https://x/c.pdf"]


def test_sentences_end_at_marks_but_not_at_full_stops(spark):
    assert one(spark, chunk.sentences("a"), "一。二！ 三?four. five；six\nseven") == ["一。", "二！", "三?", "four. five；", "six", "seven"]


def test_long_units_stay_whole_and_chunks_overlap(spark):
    text = "a" * 1000 + "! " + "b" * 500 + "! " + "c" * 300 + "! " + "d" * 200 + "!"
    plain = one(spark, chunk.chunk_text("a", overlap=0), text)
    assert [len(c) for c in plain] == [1001, 501 + 2 + 301, 201]
    lapped = one(spark, chunk.chunk_text("a"), text)
    assert lapped[0] == plain[0] and lapped[1] == plain[0][-120:] + "\n\n" + plain[1] and lapped[2] == plain[1][-120:] + "\n\n" + plain[2]


@pytest.mark.parametrize("n", [0, 1, 780, 781, 900, 1560, 1561])
def test_windows(spark, n):
    got = one(spark, chunk.window_chunks("a"), "x" * n)
    assert got == ["x" * min(900, n - s) for s in range(0, n, 780)]


def test_tokens_with_repeats(spark):
    got = one(spark, tokens.tokenize("a"), "Mail me＠x.com 《数据》 的 https://x.com/a")
    assert got == ["https://x.com/a", "me@x.com", "数据", "mail", "me@x.com", "https", "x.com", "数据"]


def test_strip_takes_unicode_white_space(spark):
    assert one(spark, strip("a"), " \x1f\n a b \x85　") == "a b"


def test_white_space_goes_without_patterns_where_none_is_needed(spark):
    import re

    from textloom.functions import columns
    from textloom.functions import text as T

    blanks = [chr(c) for c in range(0x3001) if re.fullmatch(r"\s", chr(c))]
    assert sorted(columns.BLANKS) == blanks
    texts = [*(b + "a" + b + "b" + b + b for b in blanks), "", "a", " ​ ", "a\r\nb\rc\r", "a \t b\tc", "a\n\n\n\nb", "a\n \n\n\nb", "plain text\n\nhere", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", columns.strip("t").alias("s"), T.collapse_whitespace("t").alias("c"))
    assert "regexp" not in df.select("s")._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        t = texts[r["i"]]
        assert r["s"] == (None if t is None else t.strip())
        assert r["c"] == re.sub("\n{3,}", "\n\n", re.sub("[ \t\f\x0b]+", " ", re.sub("\r\n?", "\n", t or "").replace("\xa0", " "))).strip()
