"""A versioned corpus: crawls are appended, readers see whole versions, and nothing stored is rewritten by a merge."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.columns import text
from textloom.operators.corpus import known_urls, largest_id, numbered, records
from textloom.schemas import RAW_CHUNK, RAW_DOCUMENT, names
from textloom.sources.sinks import _files, fitted
from textloom.staging import stage

#: URLs to a bucket, and the most buckets of one part of the index. Lists of buckets are the only ones the driver holds.
PER_BUCKET, MOST_BUCKETS = 100_000, 4096
#: Bits of a Bloom filter for each URL, and its hash functions: about one in a hundred unknown URLs is looked up in vain.
BITS, HASHES = 10, 7
#: Parts of the index of about the same size that are merged to one.
FAN = 8


@dataclass(frozen=True)
class IndexPart:
    name: str
    buckets: int
    words: int  # 64-bit words of a bucket's filter
    urls: int


@dataclass(frozen=True)
class Version:
    """What a version holds: the parts of its tables, those of its URL index, and where ids go on."""

    number: int = 0
    data: list[str] = field(default_factory=list)
    index: list[IndexPart] = field(default_factory=list)
    last_id: int = 0
    last_run: int = 0


class CorpusStore:
    """Documents and chunks below a folder, which crawls are merged into.

    base/documents/part=…   one part for each merge, of new rows only
    base/chunks/part=…
    base/urls/part=…/bucket=…    the URLs of a part by hash
    base/filters/part=…/bucket=…   a Bloom filter for each of these buckets, as rows (word, bits)
    base/versions/00000012.json   what version 12 holds

    A merge tests a crawl's URLs against the filters of the buckets that they fall into, looks those that may be known up in
    these buckets only, and writes parts of new rows; ids go on from the version's largest, so stored tables aren't scanned. Its
    version file is written last, by a rename: a run that is cut off leaves parts that no version names. Parts of the index are
    merged by size, so there are few of them and a URL is rewritten a logarithmic number of times.

    One writer at a time: a second one that commits the same version raises, where the file system refuses to rename over a file.
    """

    def __init__(self, spark: SparkSession, base: str, per_bucket: int = PER_BUCKET):
        self.spark, self.base, self.per_bucket = spark, base.rstrip("/"), per_bucket

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, the last one by default; version 0 is the empty store."""
        if number is None:
            number = max(self.versions(), default=0)
        if number == 0:
            return Version()
        known = json.loads(self.spark.read.text(f"{self.base}/versions/{number:08d}.json", wholetext=True).first()[0])
        return Version(**(known | {"index": [IndexPart(**p) for p in known["index"]]}))

    def _commit(self, version: Version) -> Version:
        fs, at = _files(self.spark, self.base)
        new, place = at(f"{self.base}/versions/.{uuid.uuid4().hex}"), at(f"{self.base}/versions/{version.number:08d}.json")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(asdict(version)), "utf-8"))
        out.close()
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, False)
            raise RuntimeError(f"version {version.number} was written by another run")
        return version

    def _names(self, folder: str) -> list[str]:
        fs, at = _files(self.spark, self.base)
        place = at(f"{self.base}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []

    # tables

    def documents(self, number: int | None = None) -> DataFrame:
        return self._rows("documents", RAW_DOCUMENT, number)

    def chunks(self, number: int | None = None) -> DataFrame:
        return self._rows("chunks", RAW_CHUNK, number)

    def _rows(self, name: str, schema: str, number: int | None) -> DataFrame:
        parts = self.version(number).data
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{name}/part={p}" for p in parts))

    # writing

    def start(self, documents: DataFrame, chunks: DataFrame) -> Version:
        """Version 1, of tables that were kept otherwise. All rows stay; ids go on from the largest of both."""
        if self.versions():
            raise ValueError(f"{self.base} has versions")
        last = max(largest_id(documents, "id"), largest_id(chunks, "document_id"))
        run = largest_id(documents, "run_id") if "run_id" in documents.columns else 0
        return self._add(Version(), documents, chunks, known_urls(documents, chunks), last, run)

    def merge(self, items: DataFrame, fetched_at: str, size: int = 900, overlap: int = 120) -> Version:
        """The next version: items (url, content, line and more) with content whose URL isn't known are added.

        Cases: of a URL's items the first by `line` counts; lines are unique. Items without URL are never known, and the first of
        a crawl is added. A crawl without new URLs, an empty one too, gives no version; so does one that is merged again. A column
        that documents have and items lack is null or has its default; other columns are left out.
        """
        now = self.version()
        firsts = stage(items.where(text("content") != "").groupBy("url").agg(F.min("line").alias("line")), "crawl-urls")
        lines = firsts
        known = self.known(firsts.select("url"), now)
        if known is not None:
            lines = firsts.join(known, "url", "left_anti")
        fresh = items.join(lines.select("line"), "line", "left_semi")
        fresh = stage(numbered(fresh, ["line"], "id", now.last_id), "fresh")
        count = fresh.count()
        if not count:
            return now
        documents, chunks = records(fresh, now.last_run + 1, fetched_at, size, overlap)
        return self._add(now, documents, chunks, known_urls(documents, chunks.limit(0)), now.last_id + count, now.last_run + 1)

    def _add(self, now: Version, documents: DataFrame, chunks: DataFrame, urls: DataFrame, last_id: int, last_run: int) -> Version:
        part = f"{now.number + 1:08d}-{uuid.uuid4().hex}"
        for name, df, schema in (("documents", documents, RAW_DOCUMENT), ("chunks", chunks, RAW_CHUNK)):
            fitted(df, self.spark.createDataFrame([], schema)).select(*names(schema)).write.parquet(f"{self.base}/{name}/part={part}")
        index = [*now.index, self._index(urls, part)]
        tier = [p for p in index if _tier(p) == _tier(index[-1])]
        if len(tier) >= FAN:
            together = self._urls(tier, [(p.name, b) for p in tier for b in self._buckets("urls", p)]).select("url").distinct()
            index = [*(p for p in index if p not in tier), self._index(together, f"{part}-merged")]
        return self._commit(replace(now, number=now.number + 1, data=[*now.data, part], index=index, last_id=last_id, last_run=last_run))

    def _index(self, urls: DataFrame, part: str) -> IndexPart:
        """Write a part of the index: URLs by bucket, and their filters."""
        urls = stage(urls.select("url"), "part-urls")
        count = urls.count()
        buckets = max(1, min(MOST_BUCKETS, math.ceil(count / self.per_bucket)))
        words = max(16, math.ceil(1.25 * BITS * count / buckets / 64))  # a quarter more, as buckets differ
        made = IndexPart(part, buckets, words, count)
        placed = urls.withColumn("bucket", _bucket(F.lit(buckets)))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.base}/urls/part={part}")
        bits = placed.select("bucket", F.explode(_positions(F.lit(words))).alias("at")).select("bucket", _word().alias("word"), _bit().alias("bit"))
        filters = bits.groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        filters.repartition("bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{self.base}/filters/part={part}")
        return made

    # looking up

    def known(self, urls: DataFrame, version: Version | None = None) -> DataFrame | None:
        """The urls (url, distinct) that a version has; None where it has none at all."""
        version = version or self.version()
        maybe = self.maybe_known(urls, version)
        if maybe is None:
            return None
        found = self._urls(version.index, [(r["part"], r["bucket"]) for r in maybe.select("part", "bucket").distinct().collect()])
        return maybe.join(found, ["part", "bucket", "url"], "left_semi").select("url").distinct()

    def maybe_known(self, urls: DataFrame, version: Version) -> DataFrame | None:
        """(part, bucket, url): where urls may be, by the filters; staged."""
        if not version.index:
            return None
        parts = F.array(*(F.struct(F.lit(p.name).alias("part"), F.lit(p.buckets).alias("buckets"), F.lit(p.words).alias("words")) for p in version.index))
        probes = urls.where("url <> ''").select("url", F.explode(parts).alias("p")).select("url", "p.part", _bucket(F.col("p.buckets")).alias("bucket"), F.col("p.words").alias("words"))
        touched = [(r["part"], r["bucket"]) for r in probes.select("part", "bucket").distinct().collect()]  # buckets at most
        filters = self._read("filters", "word INT, bits BIGINT", version.index, touched)
        asked = probes.select("url", "part", "bucket", F.explode(_positions(F.col("words"))).alias("at")).select("url", "part", "bucket", _word().alias("word"), _bit().alias("bit"))
        met = asked.join(filters, ["part", "bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return stage(met.groupBy("part", "bucket", "url").count().where(F.col("count") == HASHES).drop("count"), "maybe-known")

    def _urls(self, index: list[IndexPart], buckets: list[tuple[str, int]]) -> DataFrame:
        return self._read("urls", "url STRING", index, buckets)

    def _buckets(self, folder: str, part: IndexPart) -> list[int]:
        return [int(n.removeprefix("bucket=")) for n in self._names(f"{folder}/part={part.name}") if n.startswith("bucket=")]

    def _read(self, folder: str, schema: str, index: list[IndexPart], buckets: list[tuple[str, int]]) -> DataFrame:
        """Rows of these buckets, with their part and bucket; no other file is listed or opened."""
        full = f"{schema}, part STRING, bucket INT"
        there = {(p.name, b) for p in index for b in self._buckets(folder, p)}  # buckets without URLs have no folder
        paths = [f"{self.base}/{folder}/part={p}/bucket={b}" for p, b in sorted(there & set(buckets))]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.base}/{folder}").parquet(*paths)

    def vacuum(self) -> list[str]:
        """Delete the parts that no version names; not while a merge runs. Returns their names."""
        named = set()
        for number in self.versions():
            version = self.version(number)
            named |= {*version.data, *(p.name for p in version.index)}
        gone = set()
        fs, at = _files(self.spark, self.base)
        for folder in ("documents", "chunks", "urls", "filters"):
            for name in self._names(folder):
                if name.removeprefix("part=") not in named:
                    fs.delete(at(f"{self.base}/{folder}/{name}"), True)
                    gone.add(name.removeprefix("part="))
        return sorted(gone)


def _tier(part: IndexPart) -> int:
    return int(math.log(max(part.urls, 1), FAN))


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("url"), buckets).cast("int")


def _positions(words: Column) -> Column:
    """The bits of a URL in its bucket's filter."""
    return F.array(*(F.pmod(F.xxhash64("url", F.lit(i)), words * 64).cast("bigint") for i in range(1, HASHES + 1)))


def _word() -> Column:
    return F.expr("CAST(at DIV 64 AS INT)")


def _bit() -> Column:
    return F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
