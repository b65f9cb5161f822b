"""The queries of this subpackage, with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe_tree, conversation_trie, language_id, packing, phrases, quality, secret_scan, simhash, token_counts, topk_search, url_filter, vector_join, warc
from textloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.train(documents))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_warc": op9_warc,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_language_id": op12_language_id,
    "op13_conversation_trie": op13_conversation_trie,
}


def _secrets_sql() -> str:
    """The scan in DuckDB, whose patterns have no look-around: runs of the weak secrets' letters are measured instead."""
    quoted = lambda x: "'" + x.replace("'", "''").replace(r"\x20", " ") + "'"
    kinds = [(k, *x) for k, x in secret_scan.BASE.items()] + [("secret", "[A-Za-z0-9+/]+", 0, 40), ("endpoint", secret_scan.WEAK["endpoint"], 0, 1)]
    found, spans = [], []
    for k, (name, pattern, group, least) in enumerate(kinds):
        p = quoted(secret_scan.TRIED.get(name, pattern))
        found.append(f"string_split_regex(t, {p}) AS b{k}, regexp_extract_all(t, {p}, 0) AS f{k}, regexp_extract_all(t, {p}, {group}) AS g{k}")
        at = f"(list_sum(list_transform(b{k}[:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(f{k}[:i], lambda x: length(x))), 0))::INT"
        fits = f"length(g{k}[i + 1]) = 40 AND NOT starts_with(b{k}[i + 2], '=')" if name == "secret" else f"length(g{k}[i + 1]) >= {least}"
        spans.append(f"list_transform(list_filter(range(len(f{k})), lambda i: {fits}), lambda i: {{'s': {at}, 'k': {k}, 'e': ({at} + length(f{k}[i + 1]))::INT}}) AS s{k}")
    names = "[" + ", ".join(quoted(x) for x in secret_scan.KINDS) + "]"
    spelled = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda z: {names}[z.k + 1] || ':' || z.s || ':' || z.e), ','), '')"
    meets = lambda x: f"{x}.s < a.e + {secret_scan.SCOPE} AND a.s - {secret_scan.SCOPE} < {x}.e"
    near = f"list_concat(list_filter(s3, lambda w: len(list_filter(s1, lambda a: {meets('w')})) > 0), list_filter(s4, lambda w: len(list_filter(s1, lambda a: {meets('w')} AND len(list_filter(list_concat(s0, s3), lambda z: {meets('z')})) > 0)) > 0))"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {", ".join(found[:3])} FROM docs), based AS (SELECT doc_id, {", ".join(spans[:3])} FROM found),
parts AS (SELECT doc_id, {", ".join(found[3:])} FROM docs WHERE regexp_matches(t, '{secret_scan.GUARD["access"]}')),
weak AS (SELECT doc_id, {", ".join(spans[3:])} FROM parts),
linked AS (SELECT doc_id, s0, s1, s2, list_sort(list_concat(s0, s1, s2)) AS base, CASE WHEN weak.doc_id IS NULL THEN [] ELSE {near} END AS more FROM based LEFT JOIN weak USING (doc_id))
SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex, sha256({spelled("base")}) AS base_sha256, {spelled("list_sort(list_concat(base, more))")} AS spans FROM linked
"""


def _archives_sql() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substring('{letters}', (((('0x' || substring(sha, {i + 1}, 5))::INT >> {s}) & 31) + 1)::INT, 1)" for i in range(0, 40, 5) for s in (15, 10, 5, 0))
    return f"""
WITH rows AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM rows)
SELECT page_id, n AS payload_bytes, {digits} AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^(?:[^/?#]*?://)?([^/?#]*)', 1)), '.')), ',') || ')' || regexp_replace(url, '^(?:[^/?#]*?://)?[^/?#]*', '') AS urlkey,
  strftime(make_timestamp((1577836800 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM firsts
"""


_COLLOCATIONS = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM words, range(1, 6) AS ks(k), LATERAL (SELECT unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i) GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100),
longer AS (SELECT DISTINCT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a AS f, k, w FROM candidates), range(2, 5) AS ms(m), LATERAL (SELECT unnest(range(1, (k - m + 2)::BIGINT)) AS i) WHERE m < k),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 100 * c.a)),
cuts AS (SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, cut, (1000::HUGEINT * c.a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept c JOIN totals USING (lang), range(1, 5) AS cs(cut), counts l, counts r
  WHERE cut < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII string, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, o)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda c, o: {byte}), 4294967295)"


_TRIE = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, c - c % 20 AS base, ({_crc32_sql("c::VARCHAR")} % 4)::INT AS h, list(t ORDER BY p) AS own FROM turns GROUP BY c),
built AS (SELECT x.c, list_concat(coalesce(y.own, [])[1:x.h], x.own[x.h + 1:]) AS s FROM convs x LEFT JOIN convs y ON y.c = x.base),
parts AS (SELECT c, d, sha256(s[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(s[1:d - 1]::VARCHAR) END AS up, d = len(s) AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w
  FROM built, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
nodes AS (SELECT d, k, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM parts GROUP BY d, k),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.k AND kids.d = nodes.d),
sums AS (SELECT a.d, a.k, sum((f.n_children = 0)::INT)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.w)::BIGINT AS saved_tokens
  FROM full_ f JOIN parts a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.d, a.k)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (d, k) LEFT JOIN nodes p ON p.k = f.up AND p.d = f.d - 1
"""


ORACLE_SQL: dict[str, str] = {
    "op11_phrase_collocations": _COLLOCATIONS,
    "op13_conversation_trie": _TRIE,
    "op6_secret_scan": _secrets_sql(),
    "op9_warc": _archives_sql(),
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95
), reached AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a
), labels AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM labels LEFT JOIN counts USING (vec_id)
""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
