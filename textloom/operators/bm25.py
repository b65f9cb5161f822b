"""An inverted index and BM25 as joins and aggregations.

Postings are rows (term, doc_id, tf). Scoring joins query terms to postings, so only terms that are asked for move.

The best documents are found by block maxima: documents of a range of ids are a block, and for each term of a block the largest
share that any of its documents can add to a score is known. A query's block can't beat the sum of its terms' shares there. The
blocks of the largest sums are scored first; their n-th best score is a floor, and only blocks whose sum reaches it are scored
too. Postings meet queries by term and block, so a term of very many documents goes over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.staging import stage

K1, B = 1.5, 0.75
#: Documents of a block (a range of ids); blocks of a query that are scored first, besides an eighth of what is asked for; what
#: the rounding of sums may hide.
BLOCK, PROBED, SLACK = 64, 4, 1e-9


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of docs (doc_id, tokens)."""
    # an outer one, as a plain one is guarded by a filter that computes the tokens too
    return docs.select("doc_id", F.explode_outer("tokens").alias("term")).where("term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl): tokens of each document, repeats included."""
    return docs.select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).cast("bigint").alias("dl"))


def stats(dl: DataFrame) -> DataFrame:
    """One row (n, avgdl). Documents without tokens count."""
    return dl.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def term_idf(terms: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf) of postings; total: the row of stats()."""
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total), F.lit(True)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf, pos) of queries (qid, tokens): how often and where first a term is asked for."""
    return queries.select("qid", F.posexplode("tokens").alias("pos", "term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos"))


def share(k1: float, b: float) -> Column:
    """What tf occurrences in a document of dl tokens count, before the term's weight."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def block_of(doc_id: str = "doc_id") -> Column:
    return F.floor(F.col(doc_id) / BLOCK)


def block_maxima(shares: DataFrame) -> DataFrame:
    """(term, block, n, most) of shares (term, block, share): a term's documents in a block, and the largest share there."""
    return shares.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("share").alias("most"))


@dataclass
class BM25Index:
    """Tables of an index. write() keeps postings by term and block, and the blocks' maxima for the usual k1 and b, so that a
    search reads of the terms that it asks for the blocks that it scores."""

    postings: DataFrame
    lengths: DataFrame
    maxima: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame) -> BM25Index:
        return cls(postings(docs), lengths(docs))

    def write(self, path: str) -> None:
        self.postings.withColumn("block", block_of()).repartitionByRange("term", "block").sortWithinPartitions("term", "block").drop("block").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        block_maxima(self._shares(self.postings, K1, B)).repartitionByRange("term").write.parquet(f"{path}/maxima")

    @classmethod
    def read(cls, spark, path: str) -> BM25Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "maxima")))

    def _shares(self, rows: DataFrame, k1: float, b: float) -> DataFrame:
        """(term, doc_id, block, share) of postings."""
        total = stats(self.lengths)
        return rows.join(self.lengths, "doc_id").join(F.broadcast(total), F.lit(True)).select("term", "doc_id", block_of().alias("block"), share(k1, b).alias("share"))

    def _weights(self, asked: DataFrame, maxima: DataFrame) -> DataFrame:
        """(qid, term, weight, pos): a repeated term adds again."""
        total = stats(self.lengths)
        counts = maxima.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        rows = counts.join(F.broadcast(total), F.lit(True)).join(asked, "term")
        return rows.select("qid", "term", (F.col("qtf") * idf(F.col("df"), F.col("n"))).alias("weight"), "pos")

    def _opened(self, queries: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(shares of postings, maxima, weights) of the terms that queries ask for."""
        asked = query_terms(queries)
        terms = asked.select("term").distinct()
        if self.maxima is None or (k1, b) != (K1, B):
            # staged, as their maxima must be known before they are scored, and the index is read once
            shares = stage(self._shares(self.postings.join(terms, "term", "left_semi"), k1, b), "shares")
            maxima = stage(block_maxima(shares), "maxima")
        else:
            shares = None
            maxima = self.maxima.join(terms, "term", "left_semi")
        return shares, maxima, stage(self._weights(asked, maxima), "weights")

    def _scored(self, shares: DataFrame | None, blocks: DataFrame, weights: DataFrame, k1: float, b: float, digits: int | None) -> DataFrame:
        """(qid, doc_id, score, first) of the documents of blocks (qid, block) that have a term of their query."""
        wanted = blocks.select("qid", "block").join(weights, "qid")
        if shares is None:  # of a written index, the postings of these terms and blocks
            some = self.postings.withColumn("block", block_of()).join(wanted.select("term", "block").distinct(), ["term", "block"], "left_semi")
            shares = self._shares(some.drop("block"), k1, b)
        score = F.sum(F.col("weight") * F.col("share"))
        rows = shares.join(wanted, ["term", "block"]).groupBy("qid", "doc_id")
        return rows.agg((F.round(score, digits) if digits is not None else score).alias("score"), F.min("pos").alias("first"))

    def scores(self, queries: DataFrame, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
        """(qid, doc_id, score, first) for each document with a term of the query."""
        shares, maxima, weights = self._opened(queries, k1, b)
        every = maxima.select("term", "block").join(weights, "term").select("qid", "block").distinct()
        return self._scored(shares, every, weights, k1, b, digits)

    def top_n(self, queries: DataFrame, n: int = 200, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
        """The n best documents of each query with their rank from 1. Ties: the earlier query term, then doc_id."""
        return self.top_blocks(queries, n, k1, b, digits)[0]

    def top_blocks(self, queries: DataFrame, n: int = 200, k1: float = K1, b: float = B, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """top_n(), and (qid, block, bound, scored): each query's blocks and whether they had to be scored."""
        shares, maxima, weights = self._opened(queries, k1, b)
        bounds = stage(maxima.join(weights, "term").groupBy("qid", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "bounds")
        best = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
        probed = bounds.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= PROBED + n // 8).select("qid", "block", F.lit(True).alias("probed"))
        # where these hold fewer than n documents there is no floor, and all blocks are scored
        bounds = stage(bounds.join(probed, ["qid", "block"], "left").withColumn("probed", F.coalesce("probed", F.lit(False))), "bounds", instead_of=bounds)
        first = stage(self._scored(shares, bounds.where("probed"), weights, k1, b, digits), "probed")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "doc_id")
        floor = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == n).select("qid", F.col("score").alias("floor"))
        slack = SLACK * F.abs("floor") + (0.0 if digits is None else 10.0**-digits)
        blocks = stage(bounds.join(floor, "qid", "left").withColumn("scored", F.col("probed") | F.coalesce(F.col("bound") >= F.col("floor") - slack, F.lit(True))), "blocks", instead_of=bounds)
        rest = self._scored(shares, blocks.where("scored and not probed"), weights, k1, b, digits)
        ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("first")
        return ranked, blocks.select("qid", "block", "bound", "scored")
