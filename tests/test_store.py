"""The versioned store against merging whole tables."""

import random

import pytest

from textloom.operators import corpus
from textloom.schemas import RAW_CHUNK, RAW_DOCUMENT
from textloom.sources import store as S

ITEM = "url string, content string, line long, title string, canonical_url string"
AT = "2026-01-02T03:04:05+00:00"


def crawl(spark, rows):
    return spark.createDataFrame([(u, c, i, f"t{i}", k) for i, (u, c, k) in enumerate(rows)], ITEM)


def random_crawl(rng, n, urls):
    url = lambda: rng.choice([None, "", *(f"https://a.example/{rng.randrange(urls)}" for _ in range(20))])
    return [(url(), rng.choice(["", None, "x" * rng.randrange(1, 2000), "some text", "more"]), rng.choice([None, "", url()])) for _ in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merges_equal_those_of_whole_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FAN", 2)
    rng = random.Random(5)
    kept = S.CorpusStore(spark, str(tmp_path / "s"), per_bucket=7)
    documents, chunks = spark.createDataFrame([], RAW_DOCUMENT), spark.createDataFrame([], RAW_CHUNK)
    seen = []
    for n in (40, 0, 60):
        items = crawl(spark, random_crawl(rng, n, 60))
        more, parts = corpus.merge(documents, chunks, items, AT)
        documents = spark.createDataFrame(more.select(*documents.columns).collect(), RAW_DOCUMENT)
        chunks = spark.createDataFrame(parts.select(*chunks.columns).collect(), RAW_CHUNK)
        version = kept.merge(items, AT)
        assert rows(kept.documents()) == rows(documents)
        assert rows(kept.chunks()) == rows(chunks)
        seen.append((version.number, rows(documents)))
    assert [n for n, _ in seen] == [1, 1, 2]  # a crawl without items is no version
    assert rows(kept.documents(1)) == seen[0][1]
    assert len(kept.version().index) == 1 and kept.version().index[0].name.endswith("-merged")
    assert len(kept.vacuum()) == 0  # version 1 still names the parts that were merged
    has_url = items.where("url <> ''")
    assert kept.merge(has_url, AT) == kept.version(2)


def test_a_crawl_reads_only_the_buckets_that_it_may_hit(spark, tmp_path):
    kept = S.CorpusStore(spark, str(tmp_path / "s"), per_bucket=20)
    kept.merge(crawl(spark, [(f"https://a.example/{i}", "x", None) for i in range(2000)]), AT)
    part = kept.version().index[0]
    assert (part.buckets, part.urls) == (100, 2000)
    new = spark.createDataFrame([(f"https://new.example/{i}",) for i in range(1000)], "url string")
    assert kept.maybe_known(new, kept.version()).count() < 40  # about one in a hundred
    old = spark.createDataFrame([("https://a.example/7",), ("https://a.example/1999",)], "url string")
    hits = kept.maybe_known(old, kept.version())
    assert hits.count() == 2
    read = kept._urls([part], [(r["part"], r["bucket"]) for r in hits.collect()])
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) <= 2
    assert rows(kept.known(old)) == [("https://a.example/1999",), ("https://a.example/7",)]
    before = {f for f in tmp_path.rglob("*.parquet")}
    kept.merge(crawl(spark, [("https://a.example/7", "y", None), ("https://b.example/", "z", None)]), AT)
    assert before < {f for f in tmp_path.rglob("*.parquet")}  # nothing stored is rewritten
    assert kept.documents().where("run_id = 2").select("id", "url").collect() == [(2001, "https://b.example/")]


def test_every_known_url_is_found(spark, tmp_path):
    kept = S.CorpusStore(spark, str(tmp_path / "s"), per_bucket=64)
    urls = spark.range(3000).selectExpr("concat('https://a.example/', id) AS url", "'x' AS content", "id AS line")
    kept.merge(urls, AT)
    assert kept.known(urls.select("url")).count() == 3000


def test_a_merge_that_is_cut_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    kept = S.CorpusStore(spark, str(tmp_path / "s"))
    kept.merge(crawl(spark, [("u1", "x", None)]), AT)
    with monkeypatch.context() as m:
        m.setattr(S.CorpusStore, "_commit", lambda self, version: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.merge(crawl(spark, [("u2", "y", None)]), AT)
    assert [r["url"] for r in kept.documents().collect()] == ["u1"]
    assert len(kept.vacuum()) == 1 and kept.vacuum() == []
    kept.merge(crawl(spark, [("u2", "y", None)]), AT)
    assert sorted((r["id"], r["url"], r["run_id"]) for r in kept.documents().collect()) == [(1, "u1", 1), (2, "u2", 2)]
    with pytest.raises(RuntimeError):
        kept._commit(kept.version(2))


def test_a_store_starts_from_other_tables(spark, tmp_path):
    kept = S.CorpusStore(spark, str(tmp_path / "s"))
    documents = spark.createDataFrame([(2**53 + 1, "u1", "u9", 4), (None, "u1", None, None)], "id long, url string, canonical_url string, run_id long")
    chunks = spark.createDataFrame([(2**53 + 3, "a-0", "u5", "x")], "document_id long, chunk_id string, url string, text string")
    kept.start(documents, chunks)
    kept.merge(crawl(spark, [("u1", "x", None), ("u9", "x", None), ("u5", "x", None), ("u2", "x", None)]), AT)
    assert kept.documents().where("run_id = 5").select("id", "url").collect() == [(2**53 + 4, "u2")]
    assert kept.documents().count() == 3 and kept.chunks().count() == 2
    with pytest.raises(ValueError):
        kept.start(documents, chunks)


def test_an_empty_store(spark, tmp_path):
    kept = S.CorpusStore(spark, str(tmp_path / "s"))
    assert kept.version() == S.Version() and kept.documents().count() == 0 and kept.chunks().count() == 0
    assert kept.merge(crawl(spark, []), AT).number == 0 and kept.versions() == [] and kept.vacuum() == []
