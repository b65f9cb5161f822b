"""Corpus merging, ranking, deduplication, context and whole searches on small fixtures."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bm25, context, corpus, crawl, fusion, multihop, tokens, vectors
from textloom.operators.rules import RuleSet, SiteProfile
from textloom.plans.answer import Answerer, checked_model_name, compare, evaluate, to_csv_with_mark
from textloom.plans.build import BuildConfig, build, merge_crawl
from textloom.plans.search import Retriever
from textloom.schemas import EVALUATION, RAW_CHUNK, RAW_DOCUMENT
from textloom.sources import readers, sinks
from textloom.streaming.ingest import ingest, read_crawl


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, canonical_url string, run_id long")


def test_merge_keeps_first_new_urls_with_content_and_numbers_on(spark):
    old = documents(spark, [(7, "u1", "c1", 3)])
    chunks = spark.createDataFrame([(9, "9-0", 0, "u9", "", "x")], RAW_CHUNK)
    new = spark.createDataFrame([("u1", "a", 0), ("c1", "a", 1), ("u9", "a", 2), ("u2", "", 3), ("u2", "two", 4), ("u2", "again", 5), (None, "none", 6), ("u3", "y" * 1000, 7)], "url string, content string, line long")
    docs, parts = corpus.merge(old, chunks, new, "2026-01-02T00:00:00+00:00")
    got = {r["id"]: r for r in docs.collect()}
    assert sorted(got) == [7, 10, 11, 12]
    assert [got[i]["url"] for i in (10, 11, 12)] == ["u2", None, "u3"]
    assert got[10]["run_id"] == 4 and got[10]["valid_from"] == "2026-01-02" and got[10]["text_chars"] == 3
    assert sorted(r["chunk_id"] for r in parts.collect()) == ["10-0", "11-0", "12-0", "12-1", "9-0"]
    again, _ = corpus.merge(docs, parts, new.where("url is not null"), "2026-01-03")
    assert again.count() == docs.count()


def test_preprocess_prefers_raw_chunks_and_drops_empty_documents(spark):
    docs = spark.createDataFrame([(1, "u1", "T1", None), (2, "u2", None, "f2"), (3, "u3", "T3", None), (4, "", "T4", None)], "id long, url string, title string, text_path string")
    raw = spark.createDataFrame([(1, None, 0, "u1", "", "first text"), (1, "own", 1, "u1", "", "首页"), (1, "own2", 2, "u1", "", "third text"), (3, "3-0", 0, "u3", "", "更多"), (99, "99-0", 0, "", "", "orphan")], RAW_CHUNK)
    texts = spark.createDataFrame([(2, "a whole text", "p2"), (3, "never used", "p3")], "id long, content string, path string")
    out, parts = corpus.preprocess(docs, raw, texts)
    assert {r["id"]: (r["num_chunks"], r["text_chars_clean"], r["source_path"]) for r in out.collect()} == {1: (2, 20, None), 2: (1, 12, "p2")}
    assert {r["chunk_id"]: r["text"] for r in parts.collect()} == {"1-0": "T1\nu1\n\nfirst text", "own2": "T1\nu1\n\nthird text", "2-0": "u2\n\na whole text"}


def test_verify_names_every_difference(spark):
    a, b = spark.range(3), spark.range(2)
    corpus.verify({"x": a}, {"x": a})
    with pytest.raises(ValueError, match="x: 3 and 2; y: 2 and 3"):
        corpus.verify({"x": a, "y": b, "z": a}, {"x": b, "y": a, "z": a})


def test_bm25_counts_repeated_query_terms_and_breaks_ties_by_first_term(spark):
    docs = spark.createDataFrame([(1, ["b"]), (2, ["a"]), (3, ["a", "a", "c"]), (4, [])], "doc_id long, tokens array<string>")
    index = bm25.BM25Index.build(docs)
    got = index.top_n(spark.createDataFrame([(0, ["a", "c", "a"])], "qid long, tokens array<string>"), 5).collect()

    def score(tf, df, dl):
        return math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.25))

    want = {3: 2 * score(2, 2, 3) + score(1, 1, 3), 2: 2 * score(1, 2, 1)}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want)
    equal = index.top_n(spark.createDataFrame([(0, ["b", "c"]), (1, ["zz"])], "qid long, tokens array<string>"), 5).collect()
    assert [r["doc_id"] for r in sorted(equal, key=lambda r: r["rank"])][0] == 1 and {r["qid"] for r in equal} == {0}


def test_indexes_are_written_and_read(spark, tmp_path, retriever):
    docs = spark.createDataFrame([(1, ["b", "a"]), (2, ["a"]), (3, [])], "doc_id long, tokens array<string>")
    index = bm25.BM25Index.build(docs)
    index.write(str(tmp_path / "terms"))
    back = bm25.BM25Index.read(spark, str(tmp_path / "terms"))
    asked = spark.createDataFrame([(0, ["a", "b"])], "qid long, tokens array<string>")
    assert sorted(map(tuple, back.top_n(asked, 9).collect())) == sorted(map(tuple, index.top_n(asked, 9).collect()))
    sinks.write_index(retriever.embeddings, retriever.chunks, str(tmp_path / "index"))
    vectors_read, meta = spark.read.parquet(str(tmp_path / "index/vectors")), spark.read.parquet(str(tmp_path / "index/meta"))
    assert vectors_read.count() == meta.count() == 7 and meta.columns == ["idx", "chunk_id", "title", "url", "category", "text"]


def test_rank_fusion_is_symmetric_in_list_order(spark):
    rows = [(0, 0, 1.0, 5, 1), (0, 0, 1.0, 6, 2), (0, 1, 1.35, 6, 1)]
    one = {r["idx"]: r["score"] for r in fusion.rrf(spark.createDataFrame(rows, "qid long, list int, weight double, idx long, rank int")).collect()}
    two = {r["idx"]: r["score"] for r in fusion.rrf(spark.createDataFrame(rows[::-1], "qid long, list int, weight double, idx long, rank int")).collect()}
    assert one == pytest.approx(two) and one[6] == pytest.approx(1 / 62 + 1.35 / 61)


def greedy(rows):
    urls, sigs, out = set(), set(), []
    for ord_, url, sig in rows:
        if (url and url in urls) or sig in sigs:
            continue
        if url:
            urls.add(url)
        sigs.add(sig)
        out.append(ord_)
    return out


def test_a_dropped_candidate_takes_no_keys(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for qid in range(30):
        own = [(i, rng.choice(["", "u1", "u2", "u3"]), rng.choice("pqrs")) for i in range(12)]
        rows += [(qid, i, i, u, s) for i, u, s in own]
        want[qid] = greedy(own)
    got = fusion.dedup_candidates(spark.createDataFrame(rows, "qid long, ord long, idx long, url string, text string"), canonical=False).collect()
    found = {}
    for r in got:
        found.setdefault(r["qid"], []).append(r["ord"])
    assert {q: sorted(x) for q, x in found.items()} == want


def test_budget_takes_whole_pieces_then_a_prefix(spark):
    rows = [(0, 1, 50), (0, 2, 40), (0, 3, 60), (0, 4, 1), (1, 1, 90), (1, 2, 20), (2, 1, 100), (3, 1, 500)]
    got = context.within_budget(spark.createDataFrame(rows, "qid long, rank int, tokens long"), 100).collect()
    assert {(r["qid"], r["rank"]): r["keep"] for r in got} == {(0, 1): 50, (0, 2): 40, (1, 1): 90, (2, 1): 100, (3, 1): 100}


def plain_prompt(question, context_):
    return F.concat(F.lit("sys "), context_, F.lit(" ask "), question)


def test_prompts_fit_and_hold_what_fits(spark):
    """Every prompt fits; one whose contexts fit together holds them all; others hold the longest prefix by rank."""
    rng, room = random.Random(6), 100
    rows, asked = [], {}
    for qid in range(60):
        asked[qid] = "q " * rng.randrange(40)
        rows += [(qid, asked[qid], rank, " ".join(["w", "汉字", "x-y"][rng.randrange(3)] for _ in range(rng.randrange(90)))) for rank in range(1, rng.randrange(7))] or [(qid, asked[qid], 0, None)]
    got = {r["qid"]: (r["prompt"], r["n"]) for r in context.build_prompts(spark.createDataFrame(rows, "qid long, question string, rank int, text string"), plain_prompt, max_len=576 + room, new_tokens=512).withColumn("n", context.tokens_in(F.col("prompt"))).collect()}
    assert set(got) == set(asked)
    count = lambda x: len(re.findall("[一-鿿]|[^\\s一-鿿]+", x))
    for qid, (prompt, n) in got.items():
        pieces = [f"[资料{i}] {t}" for i, t in enumerate([t for q, _, _, t in rows if q == qid and t is not None], 1)]
        whole = f"sys {'\n\n'.join(pieces)} ask {asked[qid]}"
        assert n == count(prompt) <= room
        if count(whole) <= room:
            assert prompt == whole
        else:
            body = prompt.removeprefix("sys ").removesuffix(f" ask {asked[qid]}")
            assert "\n\n".join(pieces).startswith(body) and (n == room or room - n <= 32 + 2)


def test_prompts_shrink_where_tokens_do_not_add_up(spark):
    """A counter by characters counts the blank lines between parts too; the last part gives way."""
    rows = spark.createDataFrame([(1, "q", 1, "a" * 40), (1, "q", 2, "b" * 500)], "qid long, question string, rank int, text string")
    got = context.build_prompts(rows, plain_prompt, max_len=576 + 150, new_tokens=512, count=F.length, cut=lambda x, n: F.substr(x, F.lit(1), n)).first()["prompt"]
    assert len(got) == 150 and got.startswith("sys [资料1] " + "a" * 40 + "\n\n[资料2] bbb")


def test_prompts_refuse_what_cannot_fit(spark):
    rows = spark.createDataFrame([(1, "q " * 200, 0, None)], "qid long, question string, rank int, text string")
    with pytest.raises(ValueError, match="leave no room"):
        context.build_prompts(rows, plain_prompt, max_len=500)
    with pytest.raises(Exception, match="question alone"):
        context.build_prompts(rows, plain_prompt, max_len=600).collect()


def test_neighbours_respect_gaps_and_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 4, "d"), (2, 0, "x")], "doc_id long, chunk_index int, text string")
    got = {(r["doc_id"], r["chunk_index"]): r["context"] for r in context.neighbour_text(rows).collect()}
    assert got == {(1, 0): "a\n\nb", (1, 1): "a\n\nb", (1, 2): "b\n\na", (1, 4): "d", (2, 0): "x"}


def test_candidates_take_their_neighbours_by_key(spark):
    chunks = spark.createDataFrame([(0, 1, 0, "a"), (1, 1, 1, "b"), (2, 1, 1, "b2"), (3, 1, 2, "c"), (4, 2, 0, "x")], "idx long, doc_id long, chunk_index long, text string")
    rows = spark.createDataFrame([(7, 1, 1, 1, "b"), (7, 9, None, None, "own"), (8, 4, 2, 0, "x")], "qid long, idx long, doc_id long, chunk_index long, text string")
    got = {(r["qid"], r["idx"]): r["text"] for r in context.with_parent_window(rows, chunks).collect()}
    assert got == {(7, 1): "a\n\nb2\n\nc", (7, 9): "own", (8, 4): "x"}


def test_vector_search_and_matrix_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, embedding array<float>").repartition(5)
    queries = rows.where("idx < 7").withColumnRenamed("idx", "qid")
    got = {(r["qid"], r["rank"]): r["idx"] for r in vectors.search(rows, queries, 9).collect()}
    scores = x.astype(np.float64) @ x[:7].astype(np.float64).T
    assert got == {(q, k + 1): int(i) for q in range(7) for k, i in enumerate(np.argsort(-scores[:, q], kind="stable")[:9])}
    for block in (4096, 70):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        pairs = {(r["a"], r["b"]): r["score"] for r in vectors.pairwise(rows).collect()}
        unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        assert len(pairs) == 300 * 300 and np.allclose([pairs[a, b] for a in range(300) for b in range(300)], (unit @ unit.T).ravel())


def test_vector_search_takes_ties_by_number(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SCORED", 7)
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(200)], "idx long, embedding array<double>").repartition(4)
    got = vectors.search(rows, spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<double>"), 70).orderBy("rank").collect()
    assert [r["idx"] for r in got] == [i for i in range(200) if i % 3 == 2] + [1, 4, 7, 10]
    assert vectors.search(rows, rows.limit(0).withColumnRenamed("idx", "qid"), 3).count() == 0


def test_crawl_items(spark):
    page = "<html><head><title> T &amp; t </title></head><body>Hi <script>no</script><a href='/d/a.pdf'>pdf</a><!-- c --></body></html>"
    row = crawl.extract_items(spark.createDataFrame([("https://a.example.edu/x/", page)], "url string, html string")).first()
    assert (row["title"], row["content"], row["file_urls"]) == ("T & t", "Hi pdf", ["https://a.example.edu/d/a.pdf"])


def chunks_for_search(spark):
    site = SiteProfile()
    rows = [
        (0, "1-0", "课程表", "https://s.example.edu/a", None, "数据结构 【张三】 周一"),
        (1, "1-1", "课程表", "https://s.example.edu/a", None, "操作系统 【李四】 周二"),
        (2, "2-0", "张三", "https://s.example.edu/zhang", None, "张三 教师主页 邮箱 zhang@example.edu 研究方向 数据库"),
        (3, "3-0", "招生", "https://s.example.edu/2825/list.htm", None, "研究生招生 通知公告"),
        (4, "4-0", "官网", "https://www.example.edu/", None, f"{site.university} 官方网站 {site.site_url}"),
        (5, "5-0", "Hello", "https://s.example.edu/_t335/hello/main.htm", None, "hello world of words"),
        (6, "6-0", "Hello", "https://s.example.edu/hello", None, "hello other words"),
    ]
    return spark.createDataFrame(rows, "idx long, chunk_id string, title string, url string, category string, text string")


@pytest.fixture(scope="module")
def retriever(spark):
    return Retriever.build(chunks_for_search(spark), vectors.hashing_encoder())


def test_hybrid_search_takes_the_second_hop_and_shows_the_site(spark, retriever):
    asked = spark.createDataFrame([(1, "《数据结构》老师的邮箱"), (2, f"{SiteProfile().university}的官网是什么"), (3, "hello words")], "qid long, q string")
    got = {}
    for r in sorted(retriever.search(asked, 3).collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r)
    assert {0, 2} <= {r["idx"] for r in got[1]} and "操作系统" in next(r for r in got[1] if r["idx"] == 0)["text"]
    assert got[2][0]["idx"] == 4 and got[2][0]["score"] > 0.85
    assert {r["idx"] for r in got[3]} & {5, 6} and len({5, 6} & {r["idx"] for r in got[3]}) == 1  # mirrors count once


def test_dense_search_and_missing_index(spark, retriever):
    asked = spark.createDataFrame([(1, "hello world of words")], "qid long, q string")
    assert retriever.search(asked, 2, hybrid=False).orderBy("rank").first()["idx"] == 5
    with pytest.raises(ValueError, match="hybrid=True"):
        Retriever(retriever.chunks, retriever.embeddings, retriever.encoder).search(asked, hybrid=True)


def test_many_questions_for_the_address(spark, retriever):
    asked = spark.createDataFrame([(i, f"{SiteProfile().university}的官网是什么 {i}") for i in range(150)], "qid long, q string")
    found = retriever.url_evidence(asked).collect()
    assert sorted({r["qid"] for r in found}) == list(range(150)) and {r["idx"] for r in found} == {4}


def test_a_written_index_searches_alike(spark, retriever, tmp_path):
    retriever.write(str(tmp_path / "index"))
    again = Retriever.load(spark, str(tmp_path / "index"), vectors.hashing_encoder())
    asked = spark.createDataFrame([(1, "《数据结构》老师的邮箱"), (3, "hello words")], "qid long, q string")
    assert sorted(map(tuple, again.search(asked, 3).collect())) == sorted(map(tuple, retriever.search(asked, 3).collect()))


def test_words_of_the_vocabulary_are_tokens(spark):
    words = tokens.dictionary_segmenter(RuleSet().vocabulary())
    row = spark.createDataFrame([("电子信息工程与招生简章",)], "x string").select(words(F.col("x")).alias("w"), tokens.tokenize("x", words).alias("t")).first()
    assert row["w"] == ["电子信息工程", "与", "招生", "简", "章"]
    assert "电子信息工程" in row["t"] and row["t"].count("招生") == 2


def test_expansions_are_those_of_the_tables(spark):
    """Typed from the rules' description: what the questions of each kind get added, in order."""
    site = SiteProfile()
    cases = {
        "学院什么时候成立": ["学院介绍 成立于2013年 信息科学与技术学院 school of information science and technology"],
        "首任院长": ["创始院长 创院院长 首任院长 创始人 founding dean 学院介绍 信息科学与技术学院"],
        "院长": ["院长 现任院长 Dean Executive Dean 视觉与数据智能中心 VDI 师资队伍 学院介绍"],
        "《机器人》讲座": ["课程表 本硕博课程体系 本科生教学教务 研究生教学教务 course schedule 任课老师 课程代码", "学术讲座 讲座通知 学术活动 seminar lecture event", "自动化与机器人中心 STAR", "机器人"],
        "后摩尔器件与集成系统中心和智慧电气科学中心": ["研究中心 联合实验室 省部级研究中心 常任教授 VDI PMICC CIPES STAR SMIRC SSC", "后摩尔器件与集成系统中心 PMICC 新型器件 电路 系统 智慧电气科学中心 CIPES 智能电网 电动车 物联网 大数据 人工智能"],
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r["q"]: r["e"] for r in rows.select("q", RuleSet(site).expansion_list(F.col("q")).alias("e")).collect()} == cases


def test_answers_and_evaluation(spark, retriever, tmp_path):
    answerer = Answerer(retriever, lambda prompts: ["thought</think> " + str(len(p) > 0) for p in prompts], top_k=2)
    text, sources = answerer.ask(spark, "hello words")
    assert text == "True" and sources.startswith("1. Hello\n   URL: ")
    assert answerer.ask(spark, "  ")[0] == context.NO_QUESTION
    items = spark.createDataFrame([(0, "hello words", "g", "Factual"), (1, "招生", None, None)], "qid long, query string, gt_answer string, type string")
    table = evaluate(answerer, items)
    assert table.columns == EVALUATION and [r["sys_resp_hybrid"] for r in table.collect()] == ["True", "True"]
    assert compare(answerer, items, {"dense": False}).columns == ["query", "gt_answer", "type", "resp_dense", "lat_dense"]
    to_csv_with_mark(table, str(tmp_path / "t.csv"), 1)
    (written,) = (tmp_path / "t.csv").glob("part-*.csv")
    assert written.read_bytes().startswith(b"\xef\xbb\xbfquery,")


def test_a_stopped_evaluation_goes_on(spark, retriever, tmp_path):
    log, stop = tmp_path / "log", tmp_path / "stop"
    stop.touch()

    def model(prompts):
        with log.open("a") as f:
            for p in prompts:
                if p.endswith("q3") and stop.exists():
                    raise RuntimeError("stopped")
                f.write(p.rsplit("\n", 1)[-1] + "\n")
        return ["to " + p.rsplit("\n", 1)[-1] for p in prompts]

    answerer = Answerer(retriever, model, top_k=2)
    items = spark.createDataFrame([(2**53 + i, f"q{i}", None, None) for i in range(5)], "qid long, query string, gt_answer string, type string")
    at = str(tmp_path / "runs")
    with pytest.raises(Exception, match="stopped"):
        compare(answerer, items, {"a b/c": False}, at, 1).collect()
    assert log.read_text().split() == ["q0", "q1", "q2"]
    stop.unlink()
    rows = compare(answerer, items, {"a b/c": False}, at, 2)
    assert [r["resp_a b/c"] for r in rows.collect()] == [f"to q{i}" for i in range(5)]
    assert sorted(log.read_text().split()) == [f"q{i}" for i in range(5)]  # each was asked once
    compare(answerer, items.withColumn("query", F.when(F.col("query") == "q1", "new").otherwise(F.col("query"))), {"a b/c": False}, at).collect()
    assert sorted(log.read_text().split()) == ["new", *(f"q{i}" for i in range(5))]  # a question that changed is asked again
    assert compare(answerer, items.limit(0), {"a b/c": False}, at).count() == 0


def test_names_of_second_hops(spark):
    got = spark.createDataFrame([("张三、李四;Wang Li，x，Ab",)], "a string").select(multihop.split_names(F.col("a")).alias("x")).first()["x"]
    assert got == ["张三", "李四", "Wang", "Li", "Ab"]


def test_model_names(tmp_path):
    assert checked_model_name(str(tmp_path)) == str(tmp_path)
    for wrong in ("", "/path/to/your/model"):
        with pytest.raises(ValueError):
            checked_model_name(wrong)
    with pytest.raises(FileNotFoundError):
        checked_model_name("/no/such/folder")


def test_rules_read_the_site_from_its_profile(spark):
    rules = RuleSet(SiteProfile(university_en="my university", school_en="my school"))
    row = spark.createDataFrame([("英文名", "t", "u", "My University")], "q string, title string, url string, text string")
    assert row.select(rules.route_boost(F.col("q"), F.col("title"), F.col("url"), F.col("text")).alias("b")).first()["b"] == pytest.approx(0.06)


def test_build_from_crawl_to_clean_tables(spark, tmp_path):
    crawl_file = tmp_path / "crawl.jsonl"
    items = [{"url": "https://a.example.edu/1", "title": "One", "content": "text one", "file_urls": []}, {"url": "https://a.example.edu/1", "content": "again"}, {"url": "https://a.example.edu/2", "title": "Two", "content": "z" * 1700}]
    crawl_file.write_text("\n\n".join(map(json.dumps, items)) + "\n", encoding="utf-8")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):  # the second time adds nothing
        merge_crawl(spark, folder, str(crawl_file), "2026-01-02T03:04:05+00:00")
    docs, parts = build(spark, BuildConfig(folder, out))
    assert {r["id"]: r["num_chunks"] for r in docs.collect()} == {1: 1, 2: 3}
    assert parts.count() == 4
    assert spark.read.json(f"{out}/preprocess_stats.json").first()["chunks"] == 4
    assert '"category":null' in spark.read.text(f"{out}/chunks_cleaned.jsonl").first()["value"]
    with pytest.raises(ValueError, match="must differ"):
        build(spark, BuildConfig(folder, folder + "/"))


def test_a_swap_that_was_cut_off_is_undone_or_completed(spark, tmp_path):
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    read = lambda: [spark.read.json(p).first()["x"] for p in (a, b)]
    sinks.swap_jsonl(spark, {p: spark.sql("select 1 as x") for p in (a, b)})
    sinks.write_jsonl(spark.sql("select 2 as x"), a + ".new")
    sinks.finish_swap(spark, [a, b])
    assert read() == [1, 1] and not (tmp_path / "a.jsonl.new").exists()
    sinks.write_jsonl(spark.sql("select 3 as x"), b + ".new")  # a is moved already
    (tmp_path / "a.jsonl.swap").touch()
    sinks.finish_swap(spark, [a, b])
    assert read() == [1, 3] and not (tmp_path / "a.jsonl.swap").exists()
    sinks.swap_jsonl(spark, {a: spark.read.json(b), b: spark.read.json(a)})
    assert read() == [3, 1]


def test_command_line(spark, tmp_path):
    from textloom.__main__ import main

    (tmp_path / "c.jsonl").write_text(json.dumps({"url": "u", "title": "t", "content": "some text"}) + "\n", encoding="utf-8")
    main(["merge", "--folder", str(tmp_path / "in"), "--crawl", str(tmp_path / "c.jsonl")])
    main(["build", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out/chunks_cleaned.jsonl")).first()["text"] == "t\nu\n\nsome text"


def test_files_give_texts_by_suffix(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/1.txt").write_bytes(b"plain \xff text")
    (tmp_path / "raw.html").write_text("<p>a</p><p>b</p>", encoding="utf-8")
    docs = spark.createDataFrame([(1, "texts\\1.txt", "raw.html"), (2, None, "raw.html"), (3, "missing.txt", None)], "id long, text_path string, raw_path string")
    got = {r["id"]: (r["content"], r["path"]) for r in readers.document_texts(spark, docs, str(tmp_path)).collect()}
    assert got == {1: ("plain  text", "texts/1.txt"), 2: ("a\n\nb", "raw.html")}


def test_readers_and_sinks(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    (tmp_path / "x.jsonl").write_text('{"query":"a"}\n\n{"query":"b"}\n', encoding="utf-8")
    assert [r["query"] for r in readers.test_items(spark, path).orderBy("qid").collect()] == ["a", "b"]
    assert readers.read_jsonl_ordered(spark, path, "query string", 1).count() == 1
    (tmp_path / "many.jsonl").mkdir()
    for name, n in (("a", 1), ("b", 400), ("c", 30)):  # Spark reads the largest first
        (tmp_path / f"many.jsonl/{name}.json").write_text("".join(f'{{"query":"{name}{i}"}}\n' for i in range(n)), encoding="utf-8")
    got = [r["query"] for r in readers.read_jsonl_ordered(spark, str(tmp_path / "many.jsonl"), "query string").orderBy("line").collect()]
    assert got == [f"{name}{i}" for name, n in (("a", 1), ("b", 400), ("c", 30)) for i in range(n)]
    assert readers.optional_jsonl(spark, str(tmp_path / "none"), RAW_DOCUMENT).count() == 0
    assert readers.first_existing(spark, [str(tmp_path / "none"), path]) == path
    (tmp_path / "bad.jsonl").write_text('{"query":\n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "query string").collect()
    template = spark.createDataFrame([], "id long, name string, more string")
    rows = spark.createDataFrame([(3, "x", 1), (5, "y", 2)], "id long, name string, other int")
    assert sinks.rebuild(spark, {"documents": rows}, {"documents": template, "facts": template}, "kb") == {"documents": 5, "facts": 0}
    assert readers.catalogue(spark, "kb") == ["documents", "facts"] and spark.table("kb.documents").columns == ["id", "name", "more"]
    sinks.export_tables(spark, "kb", str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export/documents.jsonl")).count() == 2
    spark.sql("DROP DATABASE kb CASCADE")
    items = spark.createDataFrame([(["https://x/a%20b.pdf", "https://y/a%20b.pdf"],)], "file_urls array<string>")
    assert [tuple(r) for r in sinks.pdf_targets(items).collect()] == [("a b.pdf", "https://y/a%20b.pdf")]


def test_streaming_ingest_adds_each_url_once(spark, tmp_path):
    folder = tmp_path / "crawl"
    folder.mkdir()
    line = lambda u, c: json.dumps({"url": u, "title": "", "content": c, "file_urls": []}) + "\n"
    (folder / "a.json").write_text(line("u1", "x") + line("u1", "y") + line("u2", ""), encoding="utf-8")
    for name, text in (("", ""), ("b.json", line("u1", "z") + line("u3", "w"))):
        if name:
            (folder / name).write_text(text, encoding="utf-8")
        ingest(read_crawl(spark, str(folder)), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["u1", "u3"]


def test_texts_stay_behind_while_candidates_are_ranked(spark, retriever, monkeypatch):
    from textloom.plans import search
    from textloom.staging import stage

    staged = {}
    monkeypatch.setattr(search, "stage", lambda df, name, **kw: staged.setdefault(name, df.columns) and stage(df, name, **kw))
    asked = spark.createDataFrame([(1, f"{SiteProfile().university}的官网是什么"), (2, "hello words")], "qid long, q string")
    got = sorted(map(tuple, retriever.search(asked, 3).collect()))
    assert "pool" in staged and not {"text", "title", "haystack"} & {*staged["pool"], *staged["ranked"]}
    monkeypatch.setattr(search, "DEPTH", 2)  # it goes on where a question is short, with the same result
    assert sorted(map(tuple, retriever.search(asked, 3).collect())) == got


def test_numbered_rows_move_once(spark, monkeypatch):
    from textloom.plans import queries

    plans = []
    monkeypatch.setattr(corpus, "stage", lambda df, name, keep=corpus.stage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    chunks = queries.document_chunks(queries.documents(spark, "/root/testdata/sf0.001"))
    assert "row_number" not in chunks._jdf.queryExecution().executedPlan().toString()
    assert plans[0].index("Generate") < plans[0].index("rangepartitioning")  # chunks are made after the exchange and its sampling
    rows = sorted(map(tuple, chunks.select("idx", "chunk_id").collect()))
    assert [i for i, _ in rows] == list(range(len(rows)))
    places = [tuple(map(int, c.split("-"))) for _, c in rows]
    assert places == sorted(places)


def test_blocks_of_vectors_lie_in_small_row_groups(spark, monkeypatch, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(3).integers(-9, 9, (120_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"idx": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "x.parquet")
    staged = {}
    monkeypatch.setattr(vectors, "stage", lambda df, name, *a, _stage=vectors.stage, **kw: staged.setdefault(name, _stage(df, name, *a, **kw)))
    rows = spark.read.parquet(str(tmp_path / "x.parquet")).coalesce(1)
    got = vectors.search(rows, rows.where("idx < 3").withColumnRenamed("idx", "qid"), 5).collect()
    want = {(q, int(i)) for q in range(3) for i in np.lexsort((np.arange(len(x)), -(x @ x[q].astype(np.float64))))[:5]}
    assert {(r["qid"], r["idx"]) for r in got} == want
    # a task holds a row group as a whole, when it writes and when it reads
    groups = [g for f in staged["vector-blocks"].inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert max(g.total_byte_size for g in groups) < 24 << 20
    assert sum(g.total_byte_size for g in groups) < 1.1 * (x.nbytes + 8 * len(x))  # floats are packed as floats
