"""WARC archives with revisit records in place of repeated payloads.

Only headers (id, digest, size) are shuffled by payload digest: an aggregate with map-side
combining names the original of each digest, the record with the largest page id, and
headers are joined to it. Payloads move once, by page id, to meet their verdict. Archives
are written by Spark's own writer into the shared folder, so a lost task is written again
and no executor keeps files of its own, are compressed (one gzip member a file), and are
read back as a stream that holds one record at a time. Files are bounded: ``PER_FILE``
records of at most ``LARGE`` bytes, or ``LARGE_PER_FILE`` larger ones.

Cases: a null payload counts as empty; payloads under ``LEAST`` bytes are never revisits;
rows with equal id and payload are equal records, all responses if theirs is the largest id;
a null id never is an original while another id has the payload; line ends in a URL are
percent-encoded; a null URL leaves the header out; an empty table gives archives without
records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Scratch, table

LEAST = 1000
#: Records of an archive file; payloads above ``LARGE`` bytes go to files of their own.
PER_FILE, LARGE, LARGE_PER_FILE = 1000, 1 << 20, 8
#: Bytes that the reader unpacks at a time.
CHUNK = 1 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "record_id string, page_id long, record_type string, digest string, payload_bytes long, refers string"


def _record_id(page: str, digest: str) -> str:
    h = f"md5(concat(coalesce(CAST({page} AS STRING), ''), ':', {digest}))"
    return f"concat('<urn:uuid:', {', '.join(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (f'substr({h}, {a}, {n})', repr('-')))[:-5]}, '>')"


def headers(pages: DataFrame) -> DataFrame:
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))


def verdicts(heads: DataFrame) -> DataFrame:
    """(page_id, digest, original) of the records that become revisits, once each."""
    large = heads.filter(F.col("size") >= LEAST)
    first = large.groupBy("digest").agg(F.max("page_id").alias("original"))
    return large.join(first, "digest").filter("original IS NOT NULL AND NOT (page_id <=> original)").select("page_id", "digest", "original").distinct()


def write(pages: DataFrame, path: str) -> None:
    """Write a record per page: whole responses, and revisits that name their original."""
    revisits = verdicts(headers(pages)).withColumnRenamed("page_id", "id")
    body = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", body.alias("body")).withColumn("d", F.sha1(F.encode("body", "UTF-8")))
    known = own.join(revisits, own["page_id"].eqNullSafe(revisits["id"]) & (own["d"] == revisits["digest"]), "left")
    line = lambda name, value: f"'{name}: ', {value}, '\\r\\n'"
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', octet_length(body), '\\r\\n\\r\\n')"
    parts = known.selectExpr("page_id", "octet_length(body) AS size", "d", "original", "regexp_replace(regexp_replace(url, '\\r', '%0D'), '\\n', '%0A') AS uri", f"IF(original IS NULL, concat({http}, body), {http}) AS block")
    records = parts.selectExpr(
        "size",
        f"""concat('WARC/1.1\\r\\n', {line('WARC-Type', "IF(original IS NULL, 'response', 'revisit')")}, {line('WARC-Record-ID', _record_id('page_id', 'd'))},
            {line('WARC-Date', "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")}, IF(uri IS NULL, '', concat({line('WARC-Target-URI', 'uri')})),
            IF(page_id IS NULL, '', concat({line('X-Page-ID', 'page_id')})), {line('WARC-Payload-Digest', "concat('sha1:', d)")},
            IF(original IS NULL, '', concat({line('WARC-Profile', repr(PROFILE))}, {line('WARC-Refers-To', _record_id('original', 'd'))})),
            {line('Content-Type', "'application/http; msgtype=response'")}, 'Content-Length: ', octet_length(block), '\\r\\n\\r\\n', block) AS value"""
    )
    put = lambda rows, per_file, mode: rows.select("value").write.mode(mode).option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    put(records.filter(F.col("size") <= LARGE), PER_FILE, "errorifexists")
    if pages.filter(F.octet_length("html") > LARGE).limit(1).count():
        put(records.filter(F.col("size") > LARGE), LARGE_PER_FILE, "append")


def unpacked(data: bytes) -> Iterator[bytes]:
    """A gzip file's content in bounded parts."""
    while data:
        packer = zlib.decompressobj(wbits=31)
        while not packer.eof:
            part = packer.decompress(data, CHUNK)
            if not part and not packer.unconsumed_tail and not packer.eof:
                raise ValueError("a file is cut short")
            data = packer.unconsumed_tail
            if part:
                yield part
        data = packer.unused_data


class _Stream:
    """Bytes of a sequence of parts; only what is asked for is held."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.held, self.at = iter(parts), b"", 0

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at :] + part, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which is passed over; null at the end."""
        while (found := self.held.find(mark, self.at)) < 0:
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("no record where one should begin")
                return None
        out = self.held[self.at : found]
        self.at = found + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while True:
            part = self.held[self.at : self.at + n - got]
            parts.append(part)
            got, self.at = got + len(part), self.at + len(part)
            if got == n or not self._more():
                return b"".join(parts)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive, see ``records_of``."""
    return records_of([data])


def records_of(parts: Iterable[bytes]) -> Iterator[tuple]:
    """id, page, type, digest, payload size, record referred to, of each record.

    The digest of a response is computed from its payload and must be the one it declares.
    """
    stream = _Stream(parts)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("no record where one should begin")
        named = dict(x.split(": ", 1) for x in lines[1:])
        length = int(named["Content-Length"])
        block = stream.take(length)
        if len(block) != length or stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        digest, bytes_, kind = named["WARC-Payload-Digest"].removeprefix("sha1:"), None, named["WARC-Type"]
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            bytes_ = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{named['WARC-Record-ID']} doesn't have its digest")
        page = named.get("X-Page-ID")
        yield named["WARC-Record-ID"], None if page is None else int(page), kind, digest, bytes_, named.get("WARC-Refers-To")


def read(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        types = [pa.int64() if f.endswith("long") else pa.string() for f in READ.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                if rows := list(records_of(unpacked(content.as_py()))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, READ)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with the size and page of the response they refer to."""
    whole = records.filter("record_type = 'response'")
    found = whole.select(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("b"), F.col("page_id").alias("refers_to"), F.col("digest").alias("d")).dropDuplicates(["refers"])
    again = records.filter("record_type = 'revisit'").join(found, "refers").filter("digest = d")
    shown = lambda df, size, to: df.select("page_id", F.col(size).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", to.alias("refers_to"))
    return shown(whole, "payload_bytes", F.lit(None).cast("long")).unionByName(shown(again, "b", F.col("refers_to")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), scratch.path("archives"))
    # read once: the records' headers are kept, since both sides of the join below come from them
    return resolve(scratch.keep("records", read(spark, scratch.path("archives"))))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM m"""
