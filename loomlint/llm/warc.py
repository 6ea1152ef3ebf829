"""WARC: write captures as archives, read the archives back, assemble transactions.

Writing: a capture is a response record (or a revisit record, if another
capture with the same payload of ``REVISIT_BYTES`` or more is the response), a
request record and a metadata record; the last two name the first in
WARC-Concurrent-To, and a revisit its response in WARC-Refers-To. Records are
text lines for Spark's own writer, ended by the two line ends that end a WARC
record, so the files are archives on any storage Spark writes to. Each
partition of the pages is an archive of one gzip member; nothing is shuffled.

Reading: archives are cut into records by Content-Length, so a payload may
hold anything that looks like a record. Compressed archives, of one member or
of one member a record, are unpacked piece by piece: a task holds a stored
archive, which Spark hands over whole (2 GB at most), and one record of it.

Assembly: requests and metadata join their response by its record id, in one
shuffle; the result is one nested row per capture. Record ids are unique, so no
key is hot. A revisit takes its payload's figures from the response that it
refers to.

Which payload repeats is found by its digest, with partial aggregation: a
payload that a third of the pages share is one row per task, and broadcast.

Defined results: a null html is an empty payload; payloads shorter than
``REVISIT_BYTES`` are always responses; among pages that repeat the largest id
too, each is a response; null ids and urls are written without their fields
and read back as null; line ends in a url are written as %0A; repeated rows
give repeated captures; an empty table gives an empty result; pages of any
length are written whole; ``write`` reads page_id, url and html only, other
columns, whatever their names, play no part. An archive that is cut off or
broken gives the records before, and one of type ``damaged``, which belongs to
no capture; bytes between records are skipped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
#: Fixed for all records: archives made twice of the same pages are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = "\r\n"
RECORD = "id string, type string, concurrent_to string, refers_to string, uri string, page_id string, digest string, block_bytes bigint, headers map<string,string>, payload binary"
#: Bytes of an archive that are unpacked at a time.
PIECE = 1 << 20


def _record(kind: str, rid: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", _urn(rid)), ("WARC-Date", F.lit(DATE)), *fields, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in head]  # null where a value is
    return F.concat(F.lit("WARC/1.1" + _LINE), F.concat_ws(_LINE, *lines), F.lit(_LINE * 2), block)


def _urn(rid: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), rid, F.lit(">"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, rid, refers_to, refers_uri) of pages; rid is the id of the capture's record, refers_to that of the response a revisit refers to."""
    x = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    # rows that are equal in all columns are told apart, so that each is a capture
    x = x.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("rid", _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("row"))).drop("row")
    big = x.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "rid", "url")).alias("last"), F.count("*").alias("n"))
    repeats = common.save(big.where("n > 1").select(F.col("digest").alias("_digest"), "last", "n"), "repeats")
    # a payload that many pages share is broadcast, so that they stay where they lie; others meet theirs by digest
    hot = F.col("n") >= max(1000, -(-(repeats.agg(F.sum("n")).first()[0] or 0) // common.HOT_KEYS))
    few, rest = repeats.where(hot).select("_digest", F.col("last").alias("_hot")), repeats.where(~hot).select("_digest", "last")
    x = x.join(F.broadcast(few), x.digest == few._digest, "left").drop("_digest")
    x = x.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.col("rid"))).join(rest, F.col("_key") == F.col("_digest"), "left")
    x = x.withColumn("last", F.coalesce("_hot", "last"))
    refers = lambda c: F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id")), F.col(f"last.{c}"))
    return x.select("page_id", "url", "html", "digest", "rid", refers("rid").alias("refers_to"), refers("url").alias("refers_uri"))


def write(pages: DataFrame, path: str) -> None:
    """Write archives of ``pages`` (page_id, url, html) to the folder ``path``, one of each partition."""
    x = marked(pages)
    page, uri = ("X-Page-ID", F.col("page_id").cast("string")), ("WARC-Target-URI", F.col("url"))
    con = ("WARC-Concurrent-To", _urn(F.col("rid")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _LINE + "Content-Type: text/html; charset=utf-8" + _LINE + "Content-Length: "), F.octet_length("html").cast("string"), F.lit(_LINE * 2))
    revisit = F.col("refers_to").isNotNull()
    to = [("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", _urn(F.col("refers_to"))), ("WARC-Refers-To-Target-URI", F.col("refers_uri")), ("WARC-Refers-To-Date", F.when(revisit, F.lit(DATE)))]
    main = _record(F.when(revisit, "revisit").otherwise("response"), F.col("rid"), [page, uri, digest, *to, ("Content-Type", F.lit("application/http;msgtype=response"))], F.when(revisit, http).otherwise(F.concat(http, F.col("html"))))
    get = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^#\s]*)", 1), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1" + _LINE * 2))
    request = _record("request", _uuid(F.col("rid"), F.lit("q")), [con, uri, ("Content-Type", F.lit("application/http;msgtype=request"))], get)
    meta = _record("metadata", _uuid(F.col("rid"), F.lit("m")), [con, uri, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("fetchTimeMs: 0" + _LINE + "payload-length: "), F.octet_length("html").cast("string"), F.lit(_LINE)))
    x.select(F.explode(F.array(main, request, meta)).alias("value")).write.option("lineSep", _LINE * 2).option("compression", "gzip").text(path)


class _Reader:
    """Bytes of an archive, unpacked piece by piece; what can't be unpacked ends it."""

    def __init__(self, data: bytes):
        self.left, self.held, self.sound = memoryview(data), bytearray(), True
        self.packed = data[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Unpack some more; whether there was any."""
        if not len(self.left) or not self.sound:
            return False
        piece, self.left = self.left[:PIECE], self.left[PIECE:]
        if not self.packed:
            self.held += piece
            return True
        try:
            while len(piece):
                self.held += self.member.decompress(piece)
                if not self.member.eof:
                    break
                piece, self.member = self.member.unused_data, zlib.decompressobj(31)
        except zlib.error:
            self.sound = False
        return True

    def upto(self, mark: bytes) -> int:
        """Place of ``mark`` in what is held, unpacking as needed; -1 if it never comes."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive. Of one that is cut off or broken, the last is of type ``damaged``, without a payload."""
    r = _Reader(data)
    broken = {"head": {"WARC-Type": "damaged"}, "payload": b"", "block_bytes": 0}
    while True:
        start = r.upto(b"WARC/")
        if start < 0:
            if not r.sound or r.held.strip():
                yield broken
            return
        r.take(start)
        end = r.upto(b"\r\n\r\n")
        if end < 0:
            yield broken
            return
        head = dict(re.findall(r"([^:\r\n]+): ?([^\r\n]*)", r.take(end + 4).decode("utf-8", "replace").partition("\r\n")[2]))
        size = head.get("Content-Length", "").strip()
        block = r.take(int(size)) if size.isdigit() else b""
        if not size.isdigit() or len(block) < int(size):
            yield broken
            if not size.isdigit():
                continue
            return
        http = head.get("Content-Type", "").startswith("application/http")
        yield {"head": head, "payload": block.partition(b"\r\n\r\n")[2] if http else block, "block_bytes": len(block)}


def read(spark, path: str) -> DataFrame:
    """Records of the archives in ``path``: one row each, schema RECORD."""
    names = [c.strip().split()[0] for c in RECORD.replace("map<string,string>", "map").split(",")]
    bare = lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">")
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "block_bytes" else pa.map_(pa.string(), pa.string()) if n == "headers" else pa.string()) for n in names])

    def packed(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows, held = [], 0
                for r in parse(data.as_py()):
                    h = r["head"]
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    rows.append([bare(h.get("WARC-Record-ID")), h.get("WARC-Type"), bare(h.get("WARC-Concurrent-To")), bare(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), h.get("X-Page-ID"), digest, r["block_bytes"], list(h.items()), r["payload"]])
                    held += len(r["payload"])
                    if held > common.SLICE_BYTES or len(rows) >= common.SLICE_ROWS:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: id, and the structs response (or revisit), request and metadata; null where one is missing.

    Records meet in one shuffle, by the id that they have or are concurrent to.
    """
    whole = F.struct(*[c for c in records.columns if c not in ("id", "concurrent_to")])
    one = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), whole), ignorenulls=True)
    main = F.col("type").isin("response", "revisit")
    x = records.where(main | F.col("type").isin("request", "metadata"))
    x = x.groupBy(F.when(main, F.col("id")).otherwise(F.col("concurrent_to")).alias("id"))
    return x.agg(one("response", "revisit").alias("response"), one("request").alias("request"), one("metadata").alias("metadata")).where("response is not null")


def resolve(captures: DataFrame) -> DataFrame:
    """``captures`` with origin: of a revisit, the response record that it refers to; of a response, itself. Each has the columns of ``response``."""
    revisits = captures.where("response.type = 'revisit'").withColumn("_to", F.col("response.refers_to"))
    wanted = revisits.groupBy("_to").agg(F.count("*").alias("_n"))
    named = captures.where("response.type = 'response'").select(F.col("id").alias("_to"), F.col("response").alias("origin"))
    # a response that many revisits refer to is broadcast
    found = common.save(wanted.join(named, "_to", "left"), "warc-origins")
    total = found.agg(F.sum("_n")).first()[0] or 0
    met = common.hot_join(revisits, found, "_to", "_n", total).drop("_to")
    lone = revisits.where("_to is null").drop("_to").withColumn("origin", F.lit(None).cast(captures.schema["response"].dataType))
    return captures.where("response.type = 'response'").withColumn("origin", F.col("response")).unionByName(met).unionByName(lone)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    # payload figures are taken of what was read, before the payloads would have to move
    records = read(spark, path).withColumn("read_bytes", F.octet_length("payload").cast("long")).withColumn("read_digest", F.sha1("payload")).drop("payload", "headers")
    x = resolve(common.save(assemble(records), "warc-captures"))
    r, o = F.col("response"), F.col("origin")
    return x.select(
        r["page_id"].cast(kind).alias("page_id"), o["read_bytes"].alias("payload_bytes"), o["read_digest"].alias("payload_digest"), r["type"].alias("record_type"),
        F.when(r["type"] == "revisit", o["page_id"]).cast(kind).alias("refers_to"),
        r["uri"].alias("url"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"),
    )


#: The contract in DuckDB SQL; what else a capture holds follows from its page.
OP7_SQL = """
WITH p AS (SELECT page_id, regexp_replace(url, '[\r\n]', '%0A', 'g') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT digest, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to, url, true AS has_request, true AS has_metadata
FROM p LEFT JOIN r ON p.digest = r.digest
"""
