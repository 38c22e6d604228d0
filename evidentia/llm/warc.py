"""WARC archives of web pages, written with revisit records and read back by a reader that salvages damaged files.

Every record is a gzip member of its own. Archives are files of bounded size that Spark's text sink writes, so
they go through its commit protocol to any store that Spark reaches: a row is one archive without its last byte,
and the line separator is that byte. The last byte of a member is the highest of its record's size, 0 below
16 MB; after a larger record an empty member is put.

The reader checks what it reads: a member's own checksum, the version line, the length, the end and the digests
of a record. After a failed check it searches for the next member, or in files that are not compressed the next
version line, from which a whole record can be read, goes on from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of an archive, beyond which the next record goes to a new one.
ARCHIVE = 1 << 24
#: Bytes of payload that leave the reader in one batch, beyond its last record.
BATCH = 1 << 23
#: Digests of most copies whose responses are broadcast; rows of all others are joined by shuffle.
MOST_SENT = 200_000
#: Pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
EMPTY = zlib.compressobj(wbits=31).flush()


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _escaped(url: str) -> str:
    """Control characters and blanks would end a header line; they are percent-encoded, and nothing else is."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, record_id: str, block: bytes, content_type: str, headers: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"".join((b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in lines).encode(), b"\r\n", block, END))


def member(data: bytes) -> bytes:
    """The data as one gzip member that ends in a zero byte."""
    packer = zlib.compressobj(1, wbits=31)
    out = packer.compress(data) + packer.flush()
    return out if out.endswith(b"\0") else out + EMPTY


def page_record(page_id: int | None, copy: int, url: str | None, payload: bytes, size: int, digest: bytes, response: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone, whose length is still the payload's."""
    name = lambda i, k: f"urn:page:{'-' if i is None else i}:{k}:{base32(digest)}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", _escaped(url))] if url is not None else []
    headers.append(("WARC-Payload-Digest", "sha1:" + base32(digest)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{name(response, 0)}>")]
    else:
        block += payload
    return record("revisit" if revisit else "response", name(page_id, copy), block, "application/http; msgtype=response", headers)


def _with_responses(pages: DataFrame) -> DataFrame:
    """Adds digest, size and response (page_id of the response of pages with this payload), n_same (rows that
    have both that page_id and this payload); null response: the payload is no other page's."""
    html = common.text_or_empty("html").cast("binary")
    pages = pages.select("page_id", "url", html.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    by_page = pages.groupBy("digest", "size", "page_id").agg(F.count(F.lit(1)).alias("c"))
    greatest = F.struct(F.col("page_id").isNotNull(), "page_id")
    copied = by_page.groupBy("digest", "size").agg(F.sum("c").alias("n"), F.max("page_id").alias("response"), F.max_by("c", greatest).alias("n_same")).where("n > 1")
    copied = common.save(copied, "copied")
    total = copied.agg(F.sum("n")).first()[0] or 0
    # fewer than MOST_SENT payloads can have so many copies: these go to every task, so no key is hot in the join
    least = max(2, -(-total // MOST_SENT))
    few = F.broadcast(copied.where(F.col("n") >= least).drop("n"))
    marked = pages.join(few, ["digest", "size"], "left")
    if least == 2:
        return marked
    rest = marked.where("n_same IS NULL").drop("response", "n_same").join(copied.where(F.col("n") < least).drop("n"), ["digest", "size"], "left")
    return marked.where("n_same IS NOT NULL").unionByName(rest)


def _dealt(pages: DataFrame) -> DataFrame:
    """Adds copy (0 for the response, a number of its own for another row of its page_id) and revisit.

    Page ids that repeat with the same payload are few, if there are any; only these rows are written and counted.
    """
    same = F.col("page_id").eqNullSafe(F.col("response"))
    single = pages.where(F.coalesce(F.col("n_same") < 2, F.lit(True)) | ~same).withColumn("revisit", F.col("n_same").isNotNull() & ~same)
    single = single.withColumn("copy", F.when(F.col("revisit"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    tied = pages.where((F.col("n_same") >= 2) & same).select("*", F.struct(F.col("url").isNotNull(), "url").alias("key"))
    tied = common.save(tied.withColumn("place", F.monotonically_increasing_id()), "tied")
    if tied.isEmpty():
        return single
    heads = tied.groupBy("digest", "size").agg(F.min(F.struct("key", "place")).alias("head")).select("head.place", F.lit(False).alias("revisit"))
    tied = tied.join(heads, "place", "left").withColumn("revisit", F.coalesce("revisit", F.lit(True)))
    return single.unionByName(tied.withColumn("copy", F.when(F.col("revisit"), F.col("place") + 1).otherwise(F.lit(0))).drop("place", "key"))


def write(pages: DataFrame, path: str) -> None:
    """Writes an archive record for every row (page_id, url, html), as gzip members, in files under path.

    Of rows with one payload the greatest page_id is the response and the others revisit it; of rows that share
    that page_id too, one with the least url is the response, and they revisit their own id. Null html is an empty
    payload; empty payloads are compared like any others. A null page_id is less than all. A null url leaves its
    header out. Other columns are ignored; an empty table writes no record.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = member(record("warcinfo", "urn:archive", b"format: WARC File Format 1.1\r\n", "application/warc-fields", []))
        out, n, rows = [info], len(info), 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.large_binary())], names=["archive"])
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "copy", "url", "payload", "size", "digest", "response", "revisit")), strict=True):
                out.append(member(page_record(*(x.as_py() for x in row))))
                n, rows = n + len(out[-1]), rows + 1
                if n >= ARCHIVE:
                    yield done()
                    out, n, rows = [info], len(info), 0
        if rows:
            yield done()

    marked = _dealt(_with_responses(pages)).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    rows = marked.select("page_id", "copy", "url", "payload", "size", "digest", "response", "revisit")
    files = rows.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class Found(NamedTuple):
    """A record at a stretch of an archive's bytes."""

    begin: int
    end: int
    headers: dict[str, str]
    block: bytes


class Damaged(Exception):
    """A check has failed; the reason is the message."""


def parse(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers by lower-case name, block, end) of the record that begins at a place; raises Damaged."""
    data = memoryview(data)
    head = bytes(data[at : at + (1 << 16)])
    if not VERSION.match(head):
        raise Damaged("no version line")
    stop = head.find(END)
    if stop < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("no header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or not {"warc-type", "warc-record-id"} <= headers.keys():
        raise Damaged("headers are missing")
    begin = at + stop + len(END)
    end = begin + int(length)
    if bytes(data[end : end + len(END)]) != END:
        raise Damaged("record does not end where it should")
    block = bytes(data[begin:end])
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32(hashlib.sha1(block).digest()):
        raise Damaged("digest of the block")
    if headers["warc-type"] == "response" and (want := headers.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != base32(hashlib.sha1(payload_of(block)).digest()):
        raise Damaged("digest of the payload")
    return headers, block, end + len(END)


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(END)[2] if block.startswith(b"HTTP/") else block


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member that begins at a place; the library compares length and checksum."""
    opened, out, here = zlib.decompressobj(31), [], at
    try:
        while not opened.eof:
            fed = data[here : here + (1 << 16)]
            if not len(fed):
                raise Damaged("member is cut off")
            out.append(opened.decompress(fed))
            if here == at and not VERSION.match(out[0][:10]) and len(out[0]) >= 10:
                raise Damaged("member holds no record")  # nothing more of it need be opened
            here += len(fed)
    except zlib.error as e:
        raise Damaged("member: " + re.sub(r"[^a-z ]+", " ", str(e).rpartition(":")[2].lower()).strip()) from None
    return b"".join(out), here - len(opened.unused_data)


def _records_at(data: memoryview, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The records of the member at a place, or the record that stands there without compression."""
    if bytes(data[at : at + 3]) != MAGIC:
        headers, block, end = parse(data, at)
        return [(headers, block)], end
    content, end = _member(data, at)
    found, here = [], 0
    while here < len(content):
        headers, block, here = parse(content, here)
        found.append((headers, block))
    return found, end


def salvaged(data: bytes) -> Iterator[Found | tuple[int, int, str]]:
    """Records of an archive in order, and (begin, end, reason) for every gap that nothing could be read from.

    A gap ends where the next whole record begins, or with the archive; zero bytes and line ends between records,
    and empty members, are none.
    """
    view, at, gap, reason = memoryview(data), 0, None, ""
    start = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")  # the line end before it may be what is damaged
    while at < len(data):
        if gap is None and (blank := re.compile(rb"[\0\r\n]+").match(data, at)):
            at = blank.end()
            continue
        try:
            records, end = _records_at(view, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            following = start.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield from (Found(at, end, headers, block) for headers, block in records)
        at = end
    if gap is not None:
        yield gap, len(data), reason


COLUMNS = "archive string, begin long, end long, reason string, record_type string, record_id string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_PAGE = re.compile(r"<urn:page:(-|-?\d+):\d+:[A-Z2-7]*>")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)\r\n")


def _page_of(name: str | None) -> int | None:
    m = _PAGE.fullmatch(name or "")
    return int(m[1]) if m and m[1] != "-" else None


def _row(path: str, item, with_payload: bool) -> tuple:
    if not isinstance(item, Found):
        return (path, *item, *(None,) * 8)
    h, payload = item.headers, payload_of(item.block)
    if h["warc-type"] == "revisit":  # its payload is elsewhere: the header that it repeats tells the length
        length = _LENGTH.search(item.block)
        size, digest, payload = int(length[1]) if length else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    else:
        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
    return (path, item.begin, item.end, None, h["warc-type"], h["warc-record-id"], _page_of(h["warc-record-id"]), _page_of(h.get("warc-refers-to")), h.get("warc-target-uri"), size, digest, payload if with_payload else None)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for every record of the archives under path, and one with a reason for every gap.

    Archives may be compressed by record or not at all, or change in between. A file is read as a whole, so it
    has to be smaller than 2 GB; those that write() makes have some 16 MB.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, ARROW[kind]) for name, kind in (column.split() for column in COLUMNS.split(", "))])
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, held = [], 0
                for item in salvaged(content.as_buffer().to_pybytes()):
                    out.append(_row(name.as_py(), item, with_payload))
                    held += 200 + len(out[-1][-1] or b"")
                    if held >= BATCH:
                        yield pack(out)
                        out, held = [], 0
                if out:
                    yield pack(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, COLUMNS)


def records(found: DataFrame) -> DataFrame:
    return found.where("reason IS NULL").drop("reason")


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined stretches: archive, begin, end, reason."""
    return found.where("reason IS NOT NULL").select("archive", "begin", "end", "reason")


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = common.new_path(spark, "archives")
    write(common.table(spark, sf_dir, "pages"), path)
    back = records(read(spark, path, with_payload=False)).where("record_type IN ('response', 'revisit')")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
