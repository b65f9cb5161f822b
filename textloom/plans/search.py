"""Retrieval plans: a batch of questions against an index, dense or hybrid.

Questions are a table (qid, q), so a plan serves a batch in one go. Texts join late: ranking carries ids and scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import text
from textloom.operators import multihop, vectors
from textloom.operators.bm25 import BM25Index
from textloom.operators.context import MAX_CONTEXT_CHARS, with_parent_window
from textloom.operators.entities import entity_postings
from textloom.operators.fusion import BM25_WEIGHT, DENSE_WEIGHT, cut, first_keys, rrf
from textloom.operators.rules import RuleSet, is_exact_url_query
from textloom.operators.tokens import Segmenter, dictionary_segmenter, tokenize
from textloom.sources.readers import exists
from textloom.staging import stage

RECALL, HOP_RECALL = 200, 40
#: Digits that scores are rounded to before they are ranked, so that ties are ties on every machine. Shares of ranks have at
#: most twelve where they have an end, so none lies half-way.
DIGITS = 12
#: Candidates of a question that deduplication looks at first, and parts that a question's pool is cut in before it is ranked.
DEPTH, PARTS = 1000, 64
#: What a chunk tells of itself as a candidate.
CANDIDATE = ["title", "url", "text", "chunk_id", "doc_id", "chunk_index", "canonical_url"]


def index_meta(chunks: DataFrame) -> DataFrame:
    """Chunks (idx, chunk_id, title, url, category, text) with what retrieval derives once."""
    doc, nth = T.chunk_id_parts("chunk_id")
    return chunks.withColumns({"doc_id": doc, "chunk_index": nth, "canonical_url": T.canonical_url("url"), "haystack": T.haystack("title", "url", "text")})


@dataclass
class Retriever:
    """An index over chunks (idx, chunk_id, title, url, category, text). embeddings: (idx, embedding) of unit vectors."""

    chunks: DataFrame
    embeddings: DataFrame
    encoder: vectors.Encoder
    bm25: BM25Index | None = None
    rules: RuleSet = field(default_factory=RuleSet)
    segmenter: Segmenter | None = None
    hop: multihop.HopProfile = field(default_factory=multihop.HopProfile)
    entities: DataFrame | None = None
    context_window: int = 1
    max_context_chars: int = MAX_CONTEXT_CHARS

    @classmethod
    def build(cls, chunks: DataFrame, encoder: vectors.Encoder, hybrid: bool = True, **kw) -> Retriever:
        """Index chunks. Derived columns and vectors are staged, so that searches don't compute them again."""
        meta = stage(index_meta(chunks), "meta")
        out = cls(meta, stage(vectors.encode(meta.select("idx", "text"), encoder).select("idx", "embedding"), "embeddings"), encoder, **kw)
        if hybrid:
            tokens = stage(meta.select(F.col("idx").alias("doc_id"), out._tokens("text").alias("tokens")), "tokens")
            built = BM25Index.build(tokens)
            out.bm25 = BM25Index(stage(built.postings, "postings"), stage(built.lengths, "lengths"))
            out.entities = stage(entity_postings(meta.select("idx", "text"), out.hop.names), "entities")
        return out

    def write(self, path: str) -> None:
        """Write the index as tables below path, for load()."""
        self.chunks.write.parquet(f"{path}/chunks")
        self.embeddings.write.parquet(f"{path}/embeddings")
        if self.bm25 is not None:
            self.bm25.write(f"{path}/bm25")
        if self.entities is not None:
            self.entities.write.parquet(f"{path}/entities")

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: vectors.Encoder, **kw) -> Retriever:
        """An index that write() wrote, with the encoder (and rules, and segmenter) that it was built with."""
        bm25 = BM25Index.read(spark, f"{path}/bm25") if exists(spark, f"{path}/bm25") else None
        entities = spark.read.parquet(f"{path}/entities") if exists(spark, f"{path}/entities") else None
        return cls(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/embeddings"), encoder, bm25, entities=entities, **kw)

    def _tokens(self, column: str) -> Column:
        """Tokens of a text; without a segmenter, its words are those of the rules' vocabulary."""
        return tokenize(column, self.segmenter or dictionary_segmenter(self.rules.vocabulary()), list(self.rules.site.stopwords))

    def _dense(self, asked: DataFrame, n: int) -> DataFrame:
        """(qid, idx, score, rank) for questions (qid, q); qid whole numbers."""
        return vectors.search(self.embeddings, vectors.encode(asked, self.encoder, "q"), n, digits=DIGITS)

    def sparse(self, asked: DataFrame, n: int) -> DataFrame:
        """(qid, idx, score, rank) for questions (qid, q), by BM25."""
        return self.bm25.top_n(asked.select("qid", self._tokens("q").alias("tokens")), n, digits=DIGITS).withColumnRenamed("doc_id", "idx")

    def _boosted(self, rows: DataFrame) -> DataFrame:
        """rows (idx, q, and more) with the candidate's columns and boost."""
        # staged, as few rows meet all chunks: their size is then known, and chunks needn't move
        full = stage(rows, "found").join(self.chunks.select("idx", *CANDIDATE), "idx")
        return full.withColumn("boost", self._boost)

    @cached_property
    def _boost(self) -> Column:
        """The boost of a candidate. It is a large expression, so it is built once."""
        return self.rules.route_boost(F.col("q"), F.col("title"), F.col("url"), F.col("text"))

    def hybrid_recall(self, questions: DataFrame, n: int = RECALL) -> DataFrame:
        """Candidates of each question: every variant's dense and BM25 lists fused by rank, and boosted."""
        variants = stage(questions.select("qid", F.posexplode(self.rules.variants(F.col("q"))).alias("vid", "v")).select("qid", "vid", F.col("v.text").alias("q"), F.col("v.weight").alias("weight")), "variants")
        key = (F.col("qid") * 64 + F.col("vid")).alias("qid")  # a question has fewer variants
        asked = variants.select(key, "q")
        lists = []
        for found, own, place in ((self._dense(asked, n), DENSE_WEIGHT, 0), (self.sparse(asked, n), BM25_WEIGHT, 1)):
            part = found.select(F.floor(F.col("qid") / 64).alias("qid"), (F.col("qid") % 64).alias("vid"), "idx", "rank")
            part = part.join(variants.select("qid", "vid", "weight"), ["qid", "vid"])
            lists.append(part.select("qid", (F.col("vid") * 2 + place).alias("list"), (F.col("weight") * own).alias("weight"), "idx", "rank"))
        fused = rrf(lists[0].unionByName(lists[1]), digits=DIGITS).join(questions, "qid")
        scored = self._boosted(fused).withColumn("score", F.col("score") + F.col("boost"))
        return cut(scored, n, F.col("first"), F.col("idx")).drop("boost", "first").withColumnRenamed("rank", "ord")

    def second_hop(self, questions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(named questions, candidates that follow-up questions find). candidates: (qid, ord from 1, idx, text)."""
        named = stage(multihop.teacher_names(questions, candidates, self.entities, self.hop), "names")
        asks = stage(multihop.follow_ups(named, self.hop), "follow-ups")
        key = (F.col("qid") * 64 + F.col("nth")).alias("qid")
        asked = asks.select(key, F.col("followup").alias("q"))
        back = lambda df: df.select(F.floor(F.col("qid") / 64).alias("qid"), (F.col("qid") % 64).alias("nth"), "idx", "rank")
        scores = multihop.hop_scores(back(self._dense(asked, HOP_RECALL)), back(self.sparse(asked, HOP_RECALL)))
        found = self._boosted(scores.join(asks.select("qid", "nth", "q", "name"), ["qid", "nth"]))
        return named, multihop.hop_candidates(found, self.hop)

    def url_evidence(self, questions: DataFrame) -> DataFrame:
        """Chunks with the site's address, for questions (qid, q, and more) that ask for the university's."""
        site = self.rules.site
        asked = questions.where(is_exact_url_query(F.col("q")) & F.col("q").contains(site.university) & ~F.col("q").contains(site.school) & ~F.col("q").contains("研究生招生"))
        hits = self.chunks.where(F.col("haystack").contains(site.site_url)).select("idx", *CANDIDATE)
        # each such question with each such chunk: what is asked for, by one plan for any number of questions. Chunks are
        # scored where they lie, as every one of a site may have its address
        return hits.crossJoin(asked).withColumn("boost", self._boost).withColumn("score", multihop.EVIDENCE + F.col("boost"))

    def _first_distinct(self, pool: DataFrame, top_k: int) -> DataFrame:
        """(qid, rank, score, idx) of the first top_k candidates of each question that deduplication keeps. pool: (qid, score,
        source, seq, idx, url, sig), staged, in any order.

        It looks at DEPTH candidates, and at more only while a question that has more is short of results. A pool may hold
        most of the corpus for one question, so parts of it are cut to that depth before a task meets a question's rest.
        """
        last, depth = pool.groupBy("qid").agg(F.count("*").alias("last")), DEPTH
        order = [F.desc("score"), "source", "seq"]
        while True:
            own = Window.partitionBy("qid", "_part").orderBy(*order)
            parts = pool.withColumn("_part", F.pmod(F.xxhash64("source", "seq"), F.lit(PARTS))).withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= depth)
            some = cut(parts.drop("_part", "_n"), depth, "source", "seq").withColumnRenamed("rank", "ord")
            some = stage(some, "ranked")
            kept = some.join(first_keys(some), ["qid", "ord"], "left_semi")
            best = stage(cut(kept, top_k, F.col("ord")).select("qid", "rank", "score", "idx"), "best", instead_of=some)
            short = best.groupBy("qid").count().where(F.col("count") < top_k).join(last.where(F.col("last") > depth), "qid", "left_semi")
            if not short.limit(1).count():
                return best
            depth *= 8

    def search(self, questions: DataFrame, top_k: int = 8, hybrid: bool | None = None) -> DataFrame:
        """(qid, rank, score, idx, chunk_id, title, url, text) of the best chunks of each question (qid long, q), with the
        texts of their neighbours."""
        use = self.bm25 is not None if hybrid is None else hybrid
        if use and self.bm25 is None:
            raise ValueError("a hybrid search needs a BM25 index; build the retriever with hybrid=True")
        questions = stage(questions.select(F.col("qid").cast("bigint").alias("qid"), text("q").alias("q")), "questions")
        # what ranking and deduplication need of a candidate; its text stays behind
        light = ["qid", "score", "source", "seq", "idx", F.coalesce("canonical_url", F.lit("")).alias("url"), T.signature("text").alias("sig")]
        if use:
            first = stage(self.hybrid_recall(questions), "recall")
            named, hop = self.second_hop(questions, first)
            own = lambda df, source, seq: df.withColumns({"source": F.lit(source), "seq": seq}).select("qid", "score", "source", "seq", "idx", *CANDIDATE, "q", "names")
            asked = lambda df: df.drop("q", "names").join(named, "qid")
            pool = own(asked(first), 0, F.col("ord").cast("bigint")).unionByName(own(asked(hop), 1, F.col("nth") * (1 << 40) + F.col("idx"))).unionByName(own(self.url_evidence(named), 2, F.col("idx")))
            pool = multihop.adjusted(pool)
        else:
            found = self._dense(questions, max(4 * top_k, 20))
            pool = self._boosted(found.join(questions, "qid")).withColumns({"source": F.lit(0), "seq": F.col("rank").cast("bigint")})
        best = self._first_distinct(stage(pool.select(*light), "pool"), top_k)
        best = stage(best.join(self.chunks.select("idx", *CANDIDATE), "idx"), "best", instead_of=best)
        if self.context_window > 0:
            # the same chunk may come from two sources, so its place is part of its key
            keyed = best.withColumnsRenamed({"qid": "_qid"}).withColumn("qid", F.struct("_qid", "rank"))
            best = with_parent_window(keyed, self.chunks.where("doc_id is not null"), self.context_window, self.max_context_chars).drop("qid").withColumnRenamed("_qid", "qid")
        return best.select("qid", "rank", F.round("score", DIGITS).alias("score"), "idx", "chunk_id", "title", "url", "text")
