"""WARC archives with payload revisits, and an external merge of their indexes.

Writing: each row becomes a record, a gzip member of its own. Of records with equal payloads, that of the smallest page_id is
the response; others revisit it and carry no payload. A task rolls its records into archives by their bytes, and Spark's text
writer puts each archive into a file through its commit protocol, on any file system: an archive is one "line", whose last
byte, which is known, is the line's end. Pages whose payload surely repeats none are archived where they are read; only those
that a filter of fixed size lets through are shuffled, to be joined to what they revisit.

Reading: archives are parsed member by member; payloads are digested again and held against their headers. Each archive is a
capture run: its entries (with the offset and length of their records) are sorted by URL key, time and page. Range partitions
of the key space take the runs' fragments, and a loser tree merges them, so that partitions in order hold the global capture
histories. A partition has about MERGE_ROWS entries, however many there are.

Cases: a null html is an empty payload, a null url an empty one; empty payloads are deduplicated like others unless the least
size says otherwise; rows that repeat the smallest page_id of a payload are all responses; extra columns are ignored; an
empty table gives no rows; rows without page_id are responses; line breaks in a url are percent-encoded; a record over the
size of an archive has one for itself.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import shared_path, stage

END = b"\r\n\r\n"
#: Bytes of an archive, at most, but for a single record that is larger; bytes that reading takes at once.
FILE_BYTES, READ_BYTES = 32 << 20, 16 << 10
#: Index entries that a merging task takes, about; bits of the filter for pages that may revisit others.
MERGE_ROWS, FILTER_BITS = 200_000, 1 << 22
ENTRY = "page_id long, url string, urlkey string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long, nth long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured(page_id: int | None) -> str:
    """A page is captured page_id seconds after 2020 began."""
    return (datetime(2020, 1, 1) + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """The host's labels in reverse and what follows the host."""
    host = re.match("^(?:[^/?#]*?://)?([^/?#]*)", url)
    return ",".join(reversed(host[1].lower().split("."))) + ")" + url[host.end() :]


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, n, refers_to, refers_url): pages with what they revisit, if they do. A revisit has no payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    digests = stage(rows.select("page_id", "url", "n", "sha"), "digests")
    first = digests.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = digests.join(first, "sha").where("first.page_id < page_id").select("page_id", "sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()
    again = stage(again, "revisits")
    bit = F.pmod(F.xxhash64("page_id"), F.lit(FILTER_BITS)).cast("int")
    # a row for each 64 bits of the filter, whatever the tables' size
    words = again.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    rows = rows.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word", "left")
    maybe = F.coalesce(F.expr("(shiftrightunsigned(bits, bit & 63) & 1) = 1"), F.lit(False))
    columns = ["page_id", "url", "payload", "n", "sha"]
    alone = rows.where(~maybe).select(*columns, F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    # a payload that very many pages share is many (page_id, sha) keys, so none of them is hot
    met = rows.where(maybe).select(*columns).join(again, ["page_id", "sha"], "left").select(*columns, "refers_to", "refers_url")
    out = alone.unionByName(met.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))))
    return out.select("page_id", "url", "payload", "n", "sha", "refers_to", "refers_url")


def record(page_id: int | None, url: str, payload: bytes, n: int, sha: str, refers_to: int | None, refers_url: str | None, name: uuid.UUID) -> bytes:
    """A WARC record: an HTTP response, or a revisit of one."""
    quoted = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name.urn}>", f"WARC-Target-URI: {quoted(url)}", f"WARC-Date: {captured(page_id)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}", f"X-Payload-Length: {n}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {quoted(refers_url)}", f"WARC-Refers-To-Date: {captured(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + END + http + payload + END


def archives(pages: DataFrame, least: int, compression: str) -> DataFrame:
    """(value) whole archives without their last byte, where that is the line's end."""
    end = line_end(compression).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, nth = [], 0, 0

        def rolled() -> pa.RecordBatch:
            whole = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([whole.removesuffix(end)], pa.large_binary()).cast(pa.binary())], names=["value"])

        part = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{part} {nth} {row['page_id']} {row['sha']} {row['url']}")
                one = record(**row, name=name)
                if compression == "gzip":
                    squeeze = zlib.compressobj(wbits=31)
                    one = squeeze.compress(one) + squeeze.flush()
                nth += 1
                if held and size + len(one) > FILE_BYTES:
                    yield rolled()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield rolled()

    return planned(pages, least).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))


def line_end(compression: str) -> str:
    """What an archive's last byte is: of a gzip member, the highest byte of a size under 16 MiB; of a plain record, a line
    feed. After a larger gzip member it pads the file, as the format allows."""
    return {"gzip": "\0", "none": "\n"}[compression]


def write_archives(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """Write the records of pages (page_id, url, html) as archives under path, each record compressed by itself (or "none")."""
    archives(pages, least, compression).write.option("lineSep", line_end(compression)).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def members(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the gzip members of an archive, or of its plain records."""
    view, at = memoryview(blob), 0
    while at < len(blob):
        if blob[at] == 0:  # padding
            at += 1
            continue
        if blob[at : at + 2] == b"\x1f\x8b":
            inflate, out, end = zlib.decompressobj(wbits=31), [], at
            while not inflate.eof:
                if end >= len(blob):
                    raise ValueError("the archive ends in a member")
                out.append(inflate.decompress(view[end : end + READ_BYTES]))
                end = min(end + READ_BYTES, len(blob))
            end -= len(inflate.unused_data)
            yield at, end - at, b"".join(out)
        else:
            head = blob.find(END, at)
            found = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", blob[at:head]) if head >= 0 else None
            if not found:
                raise ValueError("the archive ends in a record's headers")
            end = head + len(END) + int(found[1]) + len(END)
            yield at, end - at, blob[at:end]
        at = end


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    if not whole.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {whole[:40]!r}")
    head, _, rest = whole.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + len(END) or not rest.endswith(END):
        raise ValueError(f"{fields['WARC-Record-ID']} doesn't end as its length says")
    return fields, rest[:n].partition(END)[2]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for each record under path, archive by archive in the order of URL key, time and page. A response's
    length and digest are those of its payload as read."""

    def entries(name: str, blob: bytes) -> Iterator[tuple]:
        for offset, length, whole in members(blob):
            head, payload = parse(whole)
            n, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
            if head["WARC-Type"] == "response" and (len(payload), base32_digest(payload)) != (n, digest):
                raise ValueError(f"{head['WARC-Record-ID']}: payload and headers differ")
            page, refers = head.get("X-Page"), head.get("X-Refers-To-Page")
            url = head["WARC-Target-URI"]
            yield page and int(page), url, url_key(url), head["WARC-Date"], head["WARC-Type"], refers and int(refers), n, digest, name, offset, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = sorted(entries(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), key=lambda r: (r[2], r[3], -1 if r[0] is None else r[0]))
                columns = list(zip(*((*r, nth) for nth, r in enumerate(rows)), strict=True))
                kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in ENTRY.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, ENTRY)


def fetch(spark: SparkSession, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of the record of an index entry, by reading nothing but its bytes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(offset)
        return parse(next(members(bytes(stream.readNBytes(length))))[2])
    finally:
        stream.close()


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of matches between run heads, the root the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if a == -1:  # not yet played: wins, to be replaced by who comes
            return True
        if b == -1:
            return False
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def merge_index(entries: DataFrame) -> DataFrame:
    """Archive entries in global order of URL key, capture time and page: partition by partition, and in each by a merge of
    its runs. Partitions are ranges of the whole key, so a URL with very many captures has several."""
    spark = entries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries.count() / MERGE_ROWS))
    # a run is sorted where it was read; its fragments are only put in their order again
    ranged = entries.repartitionByRange(parts, "urlkey", "captured", "page_id").sortWithinPartitions("archive", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        own = pa.Table.from_batches(got)
        columns = (own.column(c).to_pylist() for c in ("urlkey", "captured", "page_id"))
        keys = [(url, at, -1 if page is None else page, i) for i, (url, at, page) in enumerate(zip(*columns, strict=True))]
        runs = [iter([key for _, key in part]) for _, part in groupby(zip(own.column("archive").to_pylist(), keys, strict=True), key=lambda x: x[0])]
        yield from own.take(pa.array([key[-1] for key in LoserTree(runs)])).to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(run, ENTRY).drop("nth")


def archive(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads them back, and returns their merged index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, least)
    return merge_index(stage(read_archives(spark, path), "entries"))
