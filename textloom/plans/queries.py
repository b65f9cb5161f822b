"""The registered queries of the retrieval engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import safe_int, strip
from textloom.functions.dates import cutoff, date_boost, extract_dates
from textloom.operators import bm25, chunk, context, corpus, crawl, entities, fusion, lattice, multihop, streams, term_rules, tokens, vectors
from textloom.operators.rules import Boost, RuleSet, Trigger
from textloom.plans import search_sql
from textloom.plans import sql as S
from textloom.plans.answer import INSTRUCTION, accuracy, render_plain, source_titles
from textloom.plans.search import Retriever
from textloom.sources.store import CorpusStore
from textloom.staging import shared_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores if it comes in fewer partitions, as one small file does; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# Inline rows, the same text for both engines.
QUESTIONS = "VALUES (0, 'the and of the tion'), (50, 'der die und in'), (100, 'les des que la tion'), (150, 'zzzz')"
CJK = (
    "VALUES (1, '人工智能与机器人学'), (2, 'AI课程《数据结构》和学院介绍'), (3, '主页 https://a.example.edu/x，邮箱 who@example.edu'), "
    "(4, '中'), (5, '的 了 是'), (6, 'abc 12 x')"
)
DATED = (
    "VALUES (1, '发布 2024.1.5 和 2025-02-30', '最新讲座'), (2, '2023年 3月 4日 与 2024/12/31', '截至 2024-06-30 的通知'), (3, '没有日期', '最新'), "
    "(4, '2025-09-01', '2024-01-01 之前'), (5, '2019-05-05', '现在')"
)
URLS = (
    "VALUES (1, 'HTTPS://A.Example.edu/_t335/x//main.htm'), (2, 'https://a.example.edu/list3.htm?a=1#b'), (3, 'https://a.example.edu/_redirect?siteId=1&articleId=42'), "
    "(4, 'https://a.example.edu/%E4%B8%AD+b/'), (5, ''), (6, NULL), (7, ' https://a.example.edu/x/ ')"
)
IDS = "VALUES (1, '12', '12-3'), (2, ' 12 ', '12-'), (3, '1x5', 'a-1'), (4, 'x', '7-0'), (5, NULL, NULL)"
NAMED = (
    "VALUES (1, '《数据结构》的老师邮箱是什么', '数据结构 【张三、李四，Wang】 其他', '课程表', 'u'), (2, '王小明老师的研究方向', '无关', '主页', 'u'), "
    "(3, '《操作系统》是谁讲', '今天操作系统上课【赵六七】', '课程表', 'u'), (4, '地址在哪', '【某某】', 't', 'u')"
)
ASKED = (
    "VALUES (1, '本科毕业要多少学分', '培养方案', 'https://school.example.edu/2825/list.htm', '课程表 degree'), (2, '研究生招生网站是什么', '招生通知', 'https://school.example.edu/2825/list.htm', 'https://www.example.edu/'), "
    "(3, '信息学院的英文名是什么', 'School of Information Science and Technology symposium', 'https://x/school_en/', 'Example University'), (4, '首任院长是谁', '学院介绍', 'u', '创始院长 founding dean 现任院长'), "
    "(5, '现在的院长', '师资队伍', 'u', '现任院长 dean vdi 2025-01-01'), (6, '官网是什么', 't', 'u', 'see https://www.example.edu/ and bilibili'), (7, '《数据结构》最新讲座', 't', 'u', '数据结构 seminar 2024-03-01'), "
    "(8, '后摩尔器件与集成系统中心和智慧电气科学中心', 't', 'u', '后摩尔器件与集成系统中心 cipes'), (9, 'hello', 't', 'u', 'hello'), (10, '信息学院什么时候成立，地址在哪', 'About', 'u', 'middle example road address')"
)
RULES = RuleSet()
WORDS = "list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+'), lambda w: w <> '')"


def rows(spark: SparkSession, values: str, *names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({values}) AS t({', '.join(names)})")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokens.tokenize("text", compatible=False).alias("tokens"))


def index(spark: SparkSession, sf_dir: str) -> bm25.BM25Index:
    """An index over documents whose tokens are made once and staged, with their number beside them."""
    docs = stage(tokenised(spark, sf_dir).withColumn("dl", F.size("tokens").cast("bigint")), "tokens")
    return bm25.BM25Index(bm25.postings(docs), docs.select("doc_id", "dl"))


def questions(spark: SparkSession) -> DataFrame:
    return rows(spark, QUESTIONS, "qid", "q").withColumn("qid", F.col("qid").cast("bigint"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(chunk.window_chunks("text")).alias("chunk_index", "text"))


CHUNKED = "SELECT doc_id, i // 780 AS chunk_index, substring(text, i + 1, 900) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 780)) AS i FROM documents)"
POSTINGS = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY ALL"
LENGTHS = f"SELECT doc_id, len({S.tokens('text')}) AS dl FROM documents"
BM25 = f"""
postings AS ({POSTINGS}), lengths AS ({LENGTHS}), total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
idf AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM postings, total GROUP BY term, n),
asked AS (SELECT qid, term, count(*) AS qtf, min(pos) AS pos FROM (
  SELECT qid, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT qid, {S.tokens('q')} AS ts FROM ({QUESTIONS}) AS t(qid, q))) GROUP BY ALL),
scores AS (
  SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score, min(pos) AS first
  FROM asked JOIN postings USING (term) JOIN idf USING (term) JOIN lengths USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, doc_id) AS rank FROM scores)"""
VECTORS = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
near AS (SELECT q.vec_id AS qid, c.vec_id AS idx, round(list_inner_product(q.e, c.e), 6) AS score FROM v q, v c WHERE q.vec_id % 50 = 0),
nearest AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM near)"""


@query("SELECT doc_id, coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(lang, ''), 'und') AS lang, coalesce(n_chars, 0) AS n_chars, 'text/html' AS content_type FROM documents")
def project_defaults(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.named("source", default="unknown").alias("source"), T.named("lang", default="und").alias("lang"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), corpus.column_or(docs, "content_type", default="text/html").alias("content_type"))


@query(f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens FROM documents WHERE coalesce(text, '') <> '' AND len({S.tokens('text')}) > 0")
def filter_nonempty_tokens(spark, d):
    docs = tokenised(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))
    return docs.where("n_tokens > 0")


@query(f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {S.collapse('text')} AS t FROM documents)")
def collapse_ws(spark, d):
    t = documents(spark, d).select("doc_id", T.collapse_whitespace("text").alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {S.clean_lines('s')} AS t FROM (SELECT doc_id, {S.strip_html('text')} AS s FROM documents))")
def clean_lines(spark, d):
    t = documents(spark, d).select("doc_id", T.clean_text("text").alias("t"))
    return t.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {S.strip_html('html')} AS t FROM pages)")
def html_strip(spark, d):
    t = spread(table(spark, d, "pages")).select("page_id", T.strip_html("html").alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(f"SELECT page_id, {S.strip(S.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title("html").alias("title"))


@query(f"SELECT page_id, {S.canonical_url('url')} AS canonical_url FROM pages")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url("url").alias("canonical_url"))


@query(f"SELECT id, {S.canonical_url('url')} AS canonical_url FROM ({URLS}) AS t(id, url)")
def canonical_url_forms(spark, d):
    return rows(spark, URLS, "id", "url").select("id", T.canonical_url("url").alias("canonical_url"))


@query("SELECT page_id, nullif(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1), '') AS host, CASE WHEN html <> '' THEN sha256(html) END AS sha256, md5(url) AS url_md5, length(html) AS text_chars, '2026-01-02' AS valid_from FROM pages")
def document_fields(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_host("url").alias("host"), T.content_sha256("html").alias("sha256"), F.md5("url").alias("url_md5"), F.length("html").cast("bigint").alias("text_chars"), T.date_prefix(F.lit("2026-01-02T03:04:05+00:00")).alias("valid_from"))


@query(f"SELECT id, coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(a), '[+-]?\\d+') THEN trim(a) END AS BIGINT), 0) AS n, TRY_CAST(nullif(regexp_extract(b, '^(\\d+)-(\\d+)$', 1), '') AS BIGINT) AS doc_id, TRY_CAST(nullif(regexp_extract(b, '^(\\d+)-(\\d+)$', 2), '') AS BIGINT) AS chunk_index FROM ({IDS}) AS t(id, a, b)")
def id_values(spark, d):
    doc, nth = T.chunk_id_parts("b")
    return rows(spark, IDS, "id", "a", "b").select("id", safe_int("a").alias("n"), doc.alias("doc_id"), nth.alias("chunk_index"))


@query(f"SELECT doc_id, {S.signature('text')} AS signature FROM documents")
def signature(spark, d):
    return documents(spark, d).select("doc_id", T.signature("text").alias("signature"))


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def sentence_split(spark, d):
    s = documents(spark, d).select("doc_id", chunk.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"SELECT doc_id, unnest(range(len(c))) AS chunk_index, md5(unnest(c)) AS digest FROM (SELECT doc_id, {S.chunks(S.units('t'))} AS c FROM (SELECT doc_id, {S.collapse('text')} AS t FROM documents))")
def greedy_pack(spark, d):
    c = documents(spark, d).select("doc_id", F.posexplode_outer(chunk.chunk_text("text")).alias("i", "c")).where("i is not null")
    return c.select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), F.md5("c").alias("digest"))


@query(
    f"""
WITH listed AS (SELECT source, flatten(list({S.units('t')} ORDER BY doc_id)) AS us FROM (SELECT source, doc_id, {S.collapse('text')} AS t FROM documents) GROUP BY source)
SELECT source, unnest(range(len(c))) AS chunk_index, md5(unnest(c)) AS digest FROM (SELECT source, {S.chunks('us')} AS c FROM listed)"""
)
def pack_sources(spark, d):
    """The documents of each source as one stream, in the order of their ids."""
    docs = table(spark, d, "documents").select(F.col("source").alias("stream"), "doc_id", "text")
    packed = streams.pack_streams(docs, ["doc_id"], chunk.units_of("text"), overlap=120)
    return packed.select(F.col("stream").alias("source"), "chunk_index", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, chunk_index, md5(text) AS digest FROM ({CHUNKED})")
def window_chunks(spark, d):
    return chunked(spark, d).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("text").alias("digest"))


BARE = "regexp_replace(url, '[?#].*$', '')"


@query(f"WITH items AS (SELECT {BARE} AS url, html, page_id FROM pages), known AS (SELECT {BARE} AS url FROM pages WHERE contains(url, '?')) SELECT url, min(page_id) AS line FROM items WHERE html <> '' AND url NOT IN (SELECT url FROM known) GROUP BY url")
def upsert_anti(spark, d):
    pages = table(spark, d, "pages").withColumn("bare", F.regexp_replace("url", "[?#].*$", ""))
    old = pages.where(F.col("url").contains("?")).select(F.col("bare").alias("url"))
    new = pages.select(F.col("bare").alias("url"), F.col("html").alias("content"), F.col("page_id").alias("line"))
    return corpus.unseen(new, corpus.known_urls(old, old)).select("url", "line")


@query("SELECT page_id, 1000 + row_number() OVER (ORDER BY url, page_id) AS id FROM pages")
def assign_ids(spark, d):
    return corpus.numbered(table(spark, d, "pages").select("page_id", "url"), ["url", "page_id"], "id", 1000).select("page_id", "id")


@query(f"SELECT doc_id, count(c.text) AS n_chunks, coalesce(sum(length(c.text)), 0)::BIGINT AS chars FROM documents LEFT JOIN ({CHUNKED}) c USING (doc_id) GROUP BY doc_id")
def docs_left_chunks(spark, d):
    c = chunked(spark, d).select("doc_id", F.length("text").alias("n"))
    return table(spark, d, "documents").select("doc_id").join(c, "doc_id", "left").groupBy("doc_id").agg(F.count("n").alias("n_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))


CLEANED = f"SELECT doc_id, {S.clean_lines('s')} AS t FROM (SELECT doc_id, {S.strip_html('text')} AS s FROM documents)"


@query(f"SELECT doc_id AS document_id, unnest(range(len(c))) AS chunk_index, length(unnest(c)) AS char_count, md5(unnest(c)) AS digest FROM (SELECT doc_id, list_transform({S.chunks(S.units('t'))}, lambda z: {S.strip('z')}) AS c FROM ({CLEANED}) WHERE t <> '')")
def preprocess_corpus(spark, d):
    docs = documents(spark, d)
    stored = docs.select(F.col("doc_id").alias("id"), F.lit("").alias("url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("text_path"))
    none = spark.createDataFrame([], "document_id bigint, chunk_id string, chunk_index int, url string, title string, text string")
    _, parts = corpus.preprocess(stored, none, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("path")))
    return parts.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("char_count").cast("bigint").alias("char_count"), F.md5("text").alias("digest"))


@query("SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS source_n, (SELECT count(*) FROM labels) AS built_n WHERE (SELECT count(*) FROM documents) <> (SELECT count(*) FROM labels)")
def row_count_verify(spark, d):
    docs, pages, labels = (table(spark, d, t) for t in ("documents", "pages", "labels"))
    return corpus.count_mismatches({"documents": docs, "pages": pages}, {"documents": labels, "pages": pages})


@query(POSTINGS)
def term_frequencies(spark, d):
    return bm25.postings(tokenised(spark, d)).select("doc_id", "term", "tf")


@query(f"WITH postings AS ({POSTINGS}) SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM postings, (SELECT count(*) AS n FROM documents) GROUP BY term, n")
def df_idf(spark, d):
    # only the number of documents is used of the statistics, so texts are tokenized once
    docs = tokenised(spark, d)
    total = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return bm25.term_idf(bm25.postings(docs), total).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM ({LENGTHS})")
def doc_stats(spark, d):
    return bm25.stats(bm25.lengths(tokenised(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT CAST(qid AS BIGINT) AS qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def bm25_top10(spark, d):
    asked = questions(spark).select("qid", tokens.tokenize("q", compatible=False).alias("tokens"))
    return index(spark, d).top_n(asked, 10, digits=6).select("qid", "doc_id", "score", "rank")


@query(
    f"""
WITH t AS (SELECT id, lower(replace(text, '，', ',')) AS x FROM ({CJK}) AS t(id, text)), parts AS (
  SELECT id, flatten([regexp_extract_all(x, 'https?://[^\\s，。；、)）>]+'), regexp_extract_all(x, '[a-z0-9_.+-]+@[a-z0-9.-]+'), {S.courses("x")},
    regexp_extract_all(x, '[a-z0-9][a-z0-9_.@%+-]*'),
    flatten(list_transform(regexp_extract_all(x, '[一-鿿]+'), lambda s: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(0, greatest(length(s) - n + 1, 0)), lambda i: substring(s, i + 1, n))))))]) AS ts FROM t)
SELECT id, list_filter(ts, lambda w: length(w) > 1 AND NOT list_contains([{", ".join(map(S.lit, tokens.STOPWORDS))}], w)) AS tokens FROM parts"""
)
def tokenize_cjk(spark, d):
    return rows(spark, CJK, "id", "text").select("id", tokens.tokenize("text").alias("tokens"))


@query(f"SELECT id, flatten(list_transform(regexp_extract_all(text, '[一-鿿]+'), lambda s: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(0, greatest(length(s) - n + 1, 0)), lambda i: substring(s, i + 1, n)))))) AS grams FROM ({CJK}) AS t(id, text)")
def ngrams_2_4(spark, d):
    return rows(spark, CJK, "id", "text").select("id", tokens.cjk_ngrams("text").alias("grams"))


@query()  # a cheapest path is no query of SQL; tests hold it against all paths
def segment_unspaced(spark, d):
    """The words of each document, found again where what is between them is taken away."""
    docs = documents(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lattice.Lattice.learn(docs.select(F.explode(lattice.words_of(F.col("text"))).alias("word")))
    rows = docs.select("doc_id", lattice.words_of(F.col("text")).alias("words"), known.segmenter(r"\w+", search=False)(lattice.unspaced(F.col("text"))).alias("found"))
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.size("found").cast("bigint").alias("n_found"), F.concat_ws(" ", "words").alias("words"), F.concat_ws(" ", "found").alias("found"))
    return rows.select("doc_id", "n_words", "n_found", (F.col("words") == F.col("found")).alias("same"), F.md5("found").alias("digest"))


def _near(spark, d, n):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    return vectors.search(e, e.where("idx % 50 = 0").select(F.col("idx").alias("qid"), "embedding"), n, digits=6)


@query(f"WITH {VECTORS} SELECT qid, idx, score, CAST(rank AS INTEGER) AS rank FROM nearest WHERE rank <= 10")
def vector_topk(spark, d):
    return _near(spark, d, 10).select("qid", "idx", "score", "rank")


@query(
    """
WITH parts AS (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
means AS (SELECT label, list(m ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label)
SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 6) AS score FROM means a, means b"""
)
def pairwise_cosine(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    return vectors.pairwise(means.select(F.col("label").cast("bigint").alias("idx"), "embedding"), digits=6)


@query(
    f"""
WITH {BM25.strip()}, {VECTORS.strip()}, lists AS (
  SELECT qid, 0 AS list, 1.0::DOUBLE AS weight, idx, rank FROM nearest WHERE rank <= 20
  UNION ALL SELECT qid, 1, 1.35::DOUBLE, doc_id, rank FROM ranked WHERE rank <= 20)
SELECT qid, idx, round(sum(weight / (60 + rank)), 6) AS score FROM lists GROUP BY qid, idx"""
)
def rrf_fusion(spark, d):
    dense = _near(spark, d, 20).select("qid", F.lit(0).alias("list"), F.lit(fusion.DENSE_WEIGHT).alias("weight"), "idx", "rank")
    asked = questions(spark).select("qid", tokens.tokenize("q", compatible=False).alias("tokens"))
    sparse = index(spark, d).top_n(asked, 20, digits=6)
    sparse = sparse.select("qid", F.lit(1).alias("list"), F.lit(fusion.BM25_WEIGHT).alias("weight"), F.col("doc_id").alias("idx"), "rank")
    return fusion.rrf(dense.unionByName(sparse), digits=6).select("qid", "idx", "score")


@query(
    f"""
WITH t AS (SELECT id, q, {S.expansion_list(RULES, "q")} AS e FROM ({ASKED}) AS t(id, q, title, url, text)), v AS (
  SELECT id, q AS text, 1.0::DOUBLE AS weight FROM t UNION ALL
  SELECT id, q || ' ' || array_to_string(e, ' '), 0.9::DOUBLE FROM t WHERE len(e) > 0 UNION ALL
  SELECT id, q || ' ' || unnest(e[:4]), 0.65::DOUBLE FROM t)
SELECT id, text, weight FROM v"""
)
def expand_queries(spark, d):
    v = rows(spark, ASKED, "id", "q", "title", "url", "text").select("id", F.explode(RULES.variants(F.col("q"))).alias("v"))
    return v.select("id", F.col("v.text").alias("text"), F.col("v.weight").cast("double").alias("weight"))


@query(f"SELECT id, round({S.route_boost(RULES, 'q', 'title', 'url', 'text')}, 6) AS boost FROM ({ASKED}) AS t(id, q, title, url, text)")
def route_boost(spark, d):
    t = rows(spark, ASKED, "id", "q", "title", "url", "text")
    return t.select("id", F.round(RULES.route_boost(F.col("q"), F.col("title"), F.col("url"), F.col("text")), 6).alias("boost"))


# A table of boosts for the words of the test tables; its SQL is typed by hand.
WORD_BOOSTS = [
    Boost(Trigger(any=("the", "zz")), (((("hay", ("thtion", "thand")),), 0.25), ((("hay", ("tion",)),), 0.125))),
    Boost(Trigger(all=("of", "tion"), none=("der",)), (((("both", ("heing", "and of")),), 0.5),)),
    Boost(Trigger(any=("der", "les")), (((("title_is", ("de", "fr")),), 0.0625), ((("url", ("src1",)), ("hay", (". d", "que"))), -0.25))),
    Boost(Trigger(any=("and",)), (((("title", ("e",)), ("url", ("src2", "src19"))), 1.0), ((("hay", ("and", "ander", "anderin")),), 2.0))),
]


@query(
    f"""
WITH d AS (SELECT doc_id AS idx, coalesce(lang, '') AS title, lower(coalesce(source, '')) AS url, lower(coalesce(lang, '') || chr(10) || coalesce(source, '') || chr(10) || coalesce(text, '')) AS hay FROM documents),
p AS (SELECT * FROM d JOIN ({QUESTIONS}) AS t(qid, q) ON qid = idx % 4 * 50)
SELECT CAST(qid AS BIGINT) AS qid, idx,
  CASE WHEN q LIKE '%the%' OR q LIKE '%zz%' THEN CASE WHEN hay LIKE '%thtion%' OR hay LIKE '%thand%' THEN 0.25::DOUBLE WHEN hay LIKE '%tion%' THEN 0.125 ELSE 0 END ELSE 0 END
  + CASE WHEN q LIKE '%of%' AND q LIKE '%tion%' AND q NOT LIKE '%der%' AND hay LIKE '%heing%' AND hay LIKE '%and of%' THEN 0.5 ELSE 0 END
  + CASE WHEN q LIKE '%der%' OR q LIKE '%les%' THEN CASE WHEN title IN ('de', 'fr') THEN 0.0625 WHEN url LIKE '%src1%' AND (hay LIKE '%. d%' OR hay LIKE '%que%') THEN -0.25 ELSE 0 END ELSE 0 END
  + CASE WHEN q LIKE '%and%' THEN CASE WHEN title LIKE '%e%' AND (url LIKE '%src2%' OR url LIKE '%src19%') THEN 1 WHEN hay LIKE '%and%' OR hay LIKE '%ander%' OR hay LIKE '%anderin%' THEN 2 ELSE 0 END ELSE 0 END AS boost
FROM p"""
)
def rule_boosts(spark, d):
    boosts = term_rules.BoostTable(WORD_BOOSTS)
    asked = rows(spark, QUESTIONS, "qid", "q").select(F.col("qid").cast("bigint").alias("qid"), "q")
    chunks = documents(spark, d).select(F.col("doc_id").alias("idx"), F.col("lang").alias("title"), F.col("source").alias("url"), "text")
    pairs = chunks.select((F.col("idx") % 4 * 50).alias("qid"), "idx")
    return boosts.scores(pairs, boosts.asked(asked), boosts.held(chunks))


@query(f"SELECT id, list_transform({S.dates('body')}, lambda x: strftime(x, '%Y-%m-%d')) AS dates FROM ({DATED}) AS t(id, body, q)")
def date_extract(spark, d):
    return rows(spark, DATED, "id", "body", "q").select("id", F.transform(extract_dates("body"), lambda x: x.cast("string")).alias("dates"))


@query(f"SELECT id, round({S.date_boost(S.dates('body'), f'list_max({S.dates("q")})')}, 6) AS boost FROM ({DATED}) AS t(id, body, q)")
def date_boosts(spark, d):
    return rows(spark, DATED, "id", "body", "q").select("id", F.round(date_boost(extract_dates("body"), cutoff("q")), 6).alias("boost"))


@query(f"WITH {BM25} SELECT CAST(qid AS BIGINT) AS qid, unnest(idx) AS doc_id FROM (SELECT qid, {"list_transform(list_reduce(list(CASE WHEN TRUE THEN {'kept': [r], 'sigs': [s]} END ORDER BY r.rank), lambda a, x: CASE WHEN list_contains(a.sigs, x.sigs[1]) THEN a ELSE {'kept': list_concat(a.kept, x.kept), 'sigs': list_concat(a.sigs, x.sigs)} END).kept, lambda k: k.doc_id)"} AS idx FROM (SELECT qid, {{'rank': rank, 'doc_id': doc_id}} AS r, {S.signature('text')} AS s FROM ranked JOIN documents USING (doc_id) WHERE rank <= 200) GROUP BY qid)")
def search_dedup(spark, d):
    asked = questions(spark).select("qid", tokens.tokenize("q", compatible=False).alias("tokens"))
    found = index(spark, d).top_n(asked, 200, digits=6).select("qid", F.col("rank").alias("ord"), F.col("doc_id").alias("idx"))
    full = found.join(table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text"), "idx").withColumn("url", F.lit(""))
    return fusion.dedup_candidates(full).select("qid", F.col("idx").alias("doc_id"))


LEADS = "concat(lang, '/', regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+', 0))"


@query(
    f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE coalesce({LEADS}, '') END AS u, {S.signature("text")} AS s FROM documents),
folded AS (SELECT list_reduce(list({{'kept': [doc_id], 'urls': [u], 'sigs': [s]}} ORDER BY doc_id), lambda a, x: CASE WHEN (x.urls[1] <> '' AND list_contains(a.urls, x.urls[1])) OR list_contains(a.sigs, x.sigs[1]) THEN a
  ELSE {{'kept': list_concat(a.kept, x.kept), 'urls': list_concat(a.urls, x.urls), 'sigs': list_concat(a.sigs, x.sigs)}} END).kept AS kept FROM d)
SELECT unnest(kept) AS doc_id FROM folded"""
)
def dedup_long_list(spark, d):
    listed = table(spark, d, "documents").select(F.lit(0).cast("bigint").alias("qid"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.expr(LEADS)).alias("url"), "text")
    return fusion.dedup_long_lists(listed, canonical=False).select(F.col("idx").alias("doc_id"))


@query(
    f"""
WITH c AS ({CHUNKED}), n AS (
  SELECT doc_id, chunk_index, list_filter([lag(text) OVER w, text, lead(text) OVER w], lambda t: t IS NOT NULL) AS near FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT doc_id, chunk_index, md5(substring({S.strip("array_to_string(list_filter(near, lambda t, i: list_position(near, t) = i), chr(10) || chr(10))")}, 1, 3200)) AS digest FROM n"""
)
def neighbour_window(spark, d):
    out = context.neighbour_text(chunked(spark, d))
    return out.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("context").alias("digest"))


@query(
    f"""
WITH c AS (SELECT doc_id AS qid, chunk_index AS rank, len({WORDS}) AS tokens FROM ({CHUNKED})),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM c),
o AS (SELECT *, sum(CASE WHEN used > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth, 500 - (used - tokens) AS room FROM u)
SELECT qid, rank, tokens, CAST(CASE WHEN nth = 0 THEN tokens ELSE room END AS BIGINT) AS keep FROM o WHERE nth = 0 OR (nth = 1 AND room > 32)"""
)
def context_budget(spark, d):
    pieces = chunked(spark, d).select(F.col("doc_id").alias("qid"), F.col("chunk_index").cast("bigint").alias("rank"), F.size(tokens.blank_split("text")).cast("bigint").alias("tokens"))
    return context.within_budget(pieces, 500).select("qid", "rank", "tokens", F.col("keep").cast("bigint").alias("keep"))


@query(f"WITH {BM25} SELECT CAST(qid AS BIGINT) AS qid, string_agg(rank || '. ' || source || chr(10) || '   URL: ' || lang || chr(10) || '   摘要: ' || {S.snippet('text')}, chr(10) ORDER BY rank) AS listing FROM ranked JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY qid")
def snippet_list(spark, d):
    asked = questions(spark).select("qid", tokens.tokenize("q", compatible=False).alias("tokens"))
    found = index(spark, d).top_n(asked, 8, digits=6).select("qid", "rank", "doc_id")
    full = found.join(table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("url"), "text"), "doc_id")
    return context.source_list(full).select("qid", "listing")


@query("SELECT lang, sum(quality) FILTER (toxic = 0)::BIGINT AS \"0\", sum(quality) FILTER (toxic = 1)::BIGINT AS \"1\" FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy_pivot(spark, d):
    judged = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return accuracy(judged.select("lang", F.col("quality").alias("correct"), F.col("toxic").cast("string").alias("type")), ["lang"], ["0", "1"])


@query("SELECT lang, toxic, sum(quality)::BIGINT AS correct, count(quality) AS total, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def accuracy_rows(spark, d):
    judged = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return accuracy(judged.withColumnRenamed("quality", "correct"), ["lang", "toxic"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 8")
def topk_docs(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(8).select("doc_id", "n_chars")


@query(f"SELECT count(DISTINCT u) AS n_urls FROM (SELECT url AS u FROM pages UNION ALL SELECT {S.canonical_url('url')} FROM pages) WHERE u <> ''")
def set_ops_urls(spark, d):
    pages = table(spark, d, "pages")
    known = corpus.known_urls(pages.select("url", T.canonical_url("url").alias("canonical_url")), pages.select("url"))
    return known.agg(F.countDistinct("url").alias("n_urls"))


@query("SELECT page_id FROM pages WHERE (ends_with('.' || lower(regexp_extract(url, '//([^/?#]*)', 1)), '.example.com') OR ends_with('.' || lower(regexp_extract(url, '//([^/?#]*)', 1)), '.example.org')) AND NOT regexp_matches(url, '/es/\\d{3,}') AND url NOT IN (SELECT url FROM pages WHERE contains(url, 'utm_source'))")
def crawl_filter(spark, d):
    pages = table(spark, d, "pages")
    return crawl.crawlable(pages, ["example.com", "example.org"], r"/es/\d{3,}", pages.where(F.col("url").contains("utm_source"))).select("page_id")


VISIBLE = "regexp_extract(html, '(?is)<body\\b[^>]*>(.*)', 1)"
for _part in (r"(?is)<script\b.*?>.*?</script>", r"(?is)<style\b.*?>.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]+>"):
    VISIBLE = f"regexp_replace({VISIBLE}, '{_part}', chr(1), 'g')"
NODES = f"list_filter(list_transform(string_split({VISIBLE}, chr(1)), lambda n: {S.strip(S.unescape('n'))}), lambda n: n <> '')"
LINKS = "list_transform(list_filter(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1), lambda h: contains(h, '.pdf')), lambda h: regexp_extract(url, '^[^:]+://[^/?#]*', 0) || h)"


# one page in three gets a link to a PDF, as none has one
@query(
    f"""
WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN replace(html, '</body>', '<a class=x href=/files/a%20b.pdf>pdf</a></body>') ELSE html END AS html FROM pages)
SELECT url, {S.strip(S.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, md5(array_to_string({NODES}, ' ')) AS content, {LINKS} AS file_urls FROM p"""
)
def crawl_items(spark, d):
    pages = table(spark, d, "pages")
    more = F.replace("html", F.lit("</body>"), F.lit("<a class=x href=/files/a%20b.pdf>pdf</a></body>"))
    items = crawl.extract_items(pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, more).otherwise(F.col("html"))))
    return items.withColumn("content", F.md5("content"))


@query(f"SELECT id, list_filter(regexp_split_to_array(body, '[,，、/；;\\s]+'), lambda n: regexp_full_match(n, '[一-鿿]{{2,4}}|[A-Z][A-Za-z]+')) AS names FROM (SELECT id, regexp_extract(text, '【([^】]{{2,40}})】', 1) AS body FROM ({NAMED}) AS t(id, q, text, title, url))")
def split_names(spark, d):
    return rows(spark, NAMED, "id", "q", "text", "title", "url").select("id", multihop.split_names(F.regexp_extract("text", entities.NamePattern().bracket, 1)).alias("names"))


@query("SELECT * FROM (VALUES (1::BIGINT, ['张三', '李四', 'Wang'], 1.22::DOUBLE), (2, ['王小明'], 1.0), (3, ['赵六七'], 1.22), (4, CAST([] AS VARCHAR[]), 1.0)) AS t(qid, names, score)")
def second_hop_names(spark, d):
    t = rows(spark, NAMED, "qid", "q", "text", "title", "url").withColumn("qid", F.col("qid").cast("bigint"))
    named = multihop.teacher_names(t.select("qid", "q"), t.select("qid", F.lit(1).alias("ord"), F.col("qid").alias("idx"), "text"))
    scored = multihop.adjusted(t.withColumn("score", F.lit(1.0)).drop("q").join(named, "qid"))
    return scored.select("qid", "names", F.round("score", 6).alias("score"))


def document_chunks(docs):
    """The chunks of documents, numbered in their order over all documents."""
    spark = docs.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ranges are made of whole documents, so that sampling cuts none to chunks; a stated number of them is not put together again
    docs = docs.select("doc_id", "source", "lang", "text").repartitionByRange(parts, "doc_id")
    # an outer one, as a plain one is guarded by a filter that cuts the texts too
    docs = docs.select("doc_id", "source", "lang", F.posexplode_outer(chunk.chunk_text("text")).alias("i", "text")).where("i is not null")
    docs = corpus.numbered(docs, ["doc_id", "i"], "idx", -1, ranged=True)
    return docs.select("idx", F.concat_ws("-", "doc_id", "i").alias("chunk_id"), F.col("source").alias("title"), F.concat(F.lit("https://www.example.edu/"), "lang", F.lit("/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("category"), "text")


# with questions whose words trigger rules: lectures, dates, a person, a course, the site's address
SEARCHES = QUESTIONS + ", (200, '讲座 les des que'), (250, '最新 der die und'), (300, '王小明老师 of the'), (350, '《tion》 and'), (400, '示例大学官方网址 of the')"


def searches(spark: SparkSession) -> DataFrame:
    return rows(spark, SEARCHES, "qid", "q").withColumn("qid", F.col("qid").cast("bigint"))


@query(search_sql.hybrid_search(SEARCHES, WORDS, RULES))
def hybrid_search(spark, d):
    chunks = document_chunks(documents(spark, d))
    return Retriever.build(chunks, vectors.hashing_encoder()).search(searches(spark), 8, True)


# people as these texts have them: the word that begins the next sentence, or one in a possessive
HOP = multihop.HopProfile(
    triggers=("mail", "who "), person=r"\b([A-Z][a-z]+)'s\b",
    names=entities.NamePattern(bracket=r"[.] ([A-Z][a-z]{1,20}) ", separators=r"[ ,]+", name=r"[A-Z][a-z]{2,20}"),
    follow_up="the of und die les", profile=("the ", "token"),
)
HOPS = "VALUES (1, 'who is after 《the》 and 《of》'), (2, 'the mail of 《die》'), (3, 'no trigger for 《la》'), (4, 'who knows Anoth''s or Thandand''s 《que》'), (5, 'who 《tion? (x》'), (6, 'who 《DES》 LES des')"


@query(search_sql.second_hop(HOPS, WORDS, RULES, HOP))
def second_hop(spark, d):
    retriever = Retriever.build(document_chunks(documents(spark, d)), vectors.hashing_encoder(), hop=HOP)
    asked = rows(spark, HOPS, "qid", "q").withColumn("qid", F.col("qid").cast("bigint"))
    first = retriever.sparse(asked, multihop.CANDIDATES).join(retriever.chunks.select("idx", "text"), "idx").withColumnRenamed("rank", "ord")
    _, found = retriever.second_hop(asked, first)
    return found.select("qid", "nth", "name", "idx", F.round("score", 9).alias("score"))


@query(search_sql.dense_search(SEARCHES, WORDS))
def dense_search(spark, d):
    chunks = document_chunks(documents(spark, d))
    return Retriever.build(chunks, vectors.hashing_encoder(), hybrid=False).search(searches(spark), 8)


@query(
    f"""
WITH c AS ({CHUNKED}), asked AS (SELECT doc_id * 100000 + chunk_index AS idx, CASE WHEN chunk_index % 5 < 4 THEN doc_id END AS doc_id, chunk_index, text FROM c WHERE doc_id % 3 = 0),
near AS (SELECT a.idx, list(n.text ORDER BY n.chunk_index) AS near FROM asked a JOIN c n ON n.doc_id = a.doc_id AND n.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2 GROUP BY a.idx)
SELECT idx, md5(CASE WHEN near IS NULL THEN text ELSE substring({S.strip("array_to_string(list_filter(near, lambda t, i: list_position(near, t) = i), chr(10) || chr(10))")}, 1, 2000) END) AS digest FROM asked LEFT JOIN near USING (idx)"""
)
def parent_window(spark, d):
    c = chunked(spark, d).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    key = F.when(F.col("chunk_index") % 5 < 4, F.col("doc_id"))
    asked = c.where("doc_id % 3 = 0").select(F.lit(1).alias("qid"), (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("idx"), key.alias("doc_id"), "chunk_index", "text")
    return context.with_parent_window(asked, c, 2, 2000).select("idx", F.md5("text").alias("digest"))


OLD = f"SELECT page_id AS id, url, {S.canonical_url('url')} AS canonical_url, page_id % 7 AS run_id FROM pages WHERE page_id % 3 = 0"
NEW = "SELECT CASE WHEN page_id % 4 = 1 THEN regexp_replace(url, '[?#].*$', '') ELSE url END AS url, CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS content, page_id AS line FROM pages WHERE page_id % 5 > 0"
MERGED = f"""
old AS ({OLD}), parts AS (SELECT page_id + 1000 AS document_id, url FROM pages WHERE page_id % 9 = 1), new AS ({NEW}),
known AS (SELECT url FROM old UNION SELECT canonical_url FROM old UNION SELECT url FROM parts),
fresh AS (SELECT * FROM new WHERE coalesce(content, '') <> '' AND url NOT IN (SELECT url FROM known WHERE url <> '') QUALIFY row_number() OVER (PARTITION BY url ORDER BY line) = 1),
ids AS (SELECT *, (SELECT greatest((SELECT max(id) FROM old), (SELECT max(document_id) FROM parts))) + row_number() OVER (ORDER BY line) AS id FROM fresh)"""


def merged(spark, d):
    pages = table(spark, d, "pages")
    old = pages.where("page_id % 3 = 0").select(F.col("page_id").alias("id"), "url", T.canonical_url("url").alias("canonical_url"), (F.col("page_id") % 7).alias("run_id"))
    parts = pages.where("page_id % 9 = 1").select((F.col("page_id") + 1000).alias("document_id"), F.concat_ws("-", F.col("page_id") + 1000, F.lit(0)).alias("chunk_id"), F.lit(0).alias("chunk_index"), "url", F.lit("").alias("title"), F.lit("").alias("text"))
    url = F.when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "[?#].*$", "")).otherwise(F.col("url"))
    new = pages.where("page_id % 5 > 0").select(url.alias("url"), F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("html")).alias("content"), F.col("page_id").alias("line"))
    return corpus.merge(old, parts, new, "2026-01-02T03:04:05+00:00")


@query(
    f"""
WITH {MERGED.strip()}
SELECT id, url, canonical_url, run_id, NULL AS host, NULL AS sha256, NULL AS text_chars, NULL AS valid_from FROM old
UNION ALL SELECT id, url, url, (SELECT max(run_id) FROM old) + 1, nullif(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1), ''), sha256(content), length(content), '2026-01-02' FROM ids"""
)
def merge_documents(spark, d):
    docs, _ = merged(spark, d)
    return docs.select("id", "url", "canonical_url", "run_id", "host", "sha256", "text_chars", "valid_from")


@query(
    f"""
WITH {MERGED.strip()}
SELECT document_id, document_id || '-0' AS chunk_id, 0::BIGINT AS chunk_index, url, md5('') AS digest FROM parts
UNION ALL SELECT id, id || '-' || i // 780, i // 780, url, md5(substring(content, i + 1, 900)) FROM (SELECT id, url, content, unnest(range(0, length(content), 780)) AS i FROM ids)"""
)
def merge_chunks(spark, d):
    _, parts = merged(spark, d)
    return parts.select("document_id", "chunk_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "url", F.md5("text").alias("digest"))


PLACE = "regexp_replace(url, '[^/]*$', '')"


@query(
    f"""
WITH items AS (SELECT v, {PLACE} AS url, CASE WHEN page_id % 11 = 0 THEN '' ELSE html END AS content, page_id AS line FROM pages, (VALUES (1), (2), (3)) t(v) WHERE page_id % 4 IN (0, v)),
firsts AS (SELECT * FROM items WHERE coalesce(content, '') <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY v, line) = 1)
SELECT row_number() OVER (ORDER BY v, line) AS id, url, CAST(v AS BIGINT) AS run_id, sha256(content) AS sha256 FROM firsts"""
)
def merge_versions(spark, d):
    kept = CorpusStore(spark, shared_path(spark, "store"))
    pages = table(spark, d, "pages").select(F.expr(PLACE).alias("url"), F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("html")).alias("content"), F.col("page_id").alias("line"))
    for v in (1, 2, 3):
        kept.merge(pages.where((F.col("line") % 4).isin(0, v)), "2026-01-02T03:04:05+00:00")
    return kept.documents().select("id", "url", "run_id", "sha256")


TOKEN = r"[一-鿿]|[^\s\x0b\x1c-\x1f\x{85}\p{Z}一-鿿]+"
SPACED = rf"[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*(?:{TOKEN})"


@query(
    f"""
WITH c AS (SELECT doc_id AS qid, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS rank, text FROM ({CHUNKED})),
p AS (SELECT *, len(regexp_extract_all(piece, '{TOKEN}')) AS tokens FROM (SELECT qid, rank, '[资料' || rank || '] ' || text AS piece FROM c)),
q AS (SELECT doc_id AS qid, 'What does document ' || doc_id || ' say?' AS question FROM documents),
room AS (SELECT qid, question, 536 - len(regexp_extract_all({S.lit(INSTRUCTION)} || ' ' || question, '{TOKEN}')) AS room FROM q),
u AS (SELECT *, sum(tokens) OVER w AS used, sum(tokens) OVER (PARTITION BY qid) AS whole FROM p JOIN room USING (qid) WINDOW w AS (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, CASE WHEN used <= room THEN piece WHEN room - (used - tokens) > 32 THEN array_to_string(list_slice(regexp_extract_all(piece, '{SPACED}'), 1, room - (used - tokens)), '') END AS part FROM u WHERE used - tokens < room),
joined AS (SELECT qid, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS body FROM k GROUP BY qid)
SELECT qid, md5({S.lit(INSTRUCTION)} || chr(10) || chr(10) || coalesce(body, '') || chr(10) || chr(10) || question) AS digest FROM q LEFT JOIN joined USING (qid)"""
)
def prompts(spark, d):
    question = F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?"))
    asked = table(spark, d, "documents").select("doc_id", question.alias("question"))
    listed = asked.join(chunked(spark, d), "doc_id", "left").select(F.col("doc_id").alias("qid"), "question", F.col("chunk_index").alias("rank"), "text")
    return context.build_prompts(listed, render_plain, 800, 200).select("qid", F.md5("prompt").alias("digest"))


@query("SELECT doc_id % 50 AS qid, string_agg(source, ' | ' ORDER BY doc_id) AS titles FROM documents GROUP BY ALL")
def titles_of_sources(spark, d):
    return source_titles(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("qid"), F.col("doc_id").alias("rank"), F.col("source").alias("title")))


@query(f"WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'so</think> ' || text ELSE '</think>' || text || '</think> x' END AS t FROM documents) SELECT doc_id, md5({S.strip("CASE WHEN contains(t, '</think>') THEN substring(t, instr(t, '</think>') + 8) ELSE t END")}) AS digest FROM t")
def answers_after_thinking(spark, d):
    said = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("so</think> "), "text")).otherwise(F.concat(F.lit("</think>"), "text", F.lit("</think> x")))
    return documents(spark, d).select("doc_id", F.md5(T.after_thinking(said)).alias("digest"))


@query("SELECT page_id, url_decode(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/]*$', 0)) AS file_name FROM pages")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.file_name("url").alias("file_name"))


BLANKS = r"[ \t\f\x0b]+"
BARE_HTML = "html"
for _tag in ("script", "style", "noscript"):
    BARE_HTML = rf"regexp_replace({BARE_HTML}, '(?is)<{_tag}\b.*?>.*?</{_tag}>', ' ', 'g')"
FILE_TEXT = S.collapse(rf"regexp_replace(regexp_replace({S.unescape(f"regexp_replace({BARE_HTML}, '(?s)<[^>]+>', chr(10), 'g')")}, '{BLANKS}\n', chr(10), 'g'), '\n{BLANKS}', chr(10), 'g')")


@query(f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {FILE_TEXT} AS t FROM pages)")
def html_file_text(spark, d):
    t = spread(table(spark, d, "pages")).select("page_id", T.html_text("html").alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("WITH t AS (SELECT page_id, url, ['text/html; charset=utf-8', 'application/pdf', 'text/html', NULL][page_id % 4 + 1] AS kind FROM pages) SELECT page_id FROM t WHERE starts_with(kind, 'text/html') AND ends_with('.' || lower(regexp_extract(url, '//([^/?#]*)', 1)), '.example.net')")
def crawl_content_types(spark, d):
    kinds = F.array(F.lit("text/html; charset=utf-8"), F.lit("application/pdf"), F.lit("text/html"), F.lit(None).cast("string"))
    pages = table(spark, d, "pages").withColumn("content_type", F.get(kinds, (F.col("page_id") % 4).cast("int")))
    return crawl.crawlable(pages, ["example.net"]).select("page_id")


# no page of the tables links to another: a link's word stands for a page of topics, which links to pages whose title it begins
TOPIC = "lower(regexp_extract(trim(regexp_extract(html, '<title>([^<]*)', 1)), '^[^ <&*#%.,]+', 0))"


@query(f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT url, lower(unnest(regexp_extract_all(html, '<a href="(/[^"/]+)"', 1))) AS target FROM pages
  UNION SELECT '/' || {TOPIC}, url FROM pages WHERE {TOPIC} <> ''),
reached AS (SELECT url, 0 AS depth FROM pages WHERE page_id % 50 = 0 UNION SELECT target, depth + 1 FROM reached JOIN links USING (url) WHERE depth < 6),
first AS (SELECT url, min(depth) AS depth FROM reached GROUP BY url)
SELECT f.url, CAST(f.depth AS INTEGER) AS depth, min(p.url) AS parent
FROM first f LEFT JOIN links l ON l.target = f.url LEFT JOIN first p ON p.url = l.url AND p.depth = f.depth - 1 GROUP BY ALL""")
def crawl_frontier(spark, d):
    pages = table(spark, d, "pages")
    links = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"/]+)"'), F.lit(1))).alias("target")).withColumn("target", F.lower("target"))
    topics = pages.select(F.concat(F.lit("/"), F.expr(TOPIC)).alias("url"), F.col("url").alias("target")).where("url <> '/'")
    return crawl.follow(links.unionByName(topics).distinct(), pages.where("page_id % 50 = 0").select("url"), 6)


SITE = "regexp_extract(url, '^[^:]+://[^/?#]*', 0)"


@query(f"SELECT page_id, list_transform(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda h: {SITE} || h) AS links FROM pages")
def absolute_links(spark, d):
    found = table(spark, d, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("hrefs"))
    return found.select("page_id", T.joined_urls("url", "hrefs").alias("links"))
