"""WARC archives with a two-level capture index.

Writing: every page becomes a WARC/1.1 record, a gzip member of its own, in archive files of the shared folder; one
task writes one file. Of records with equal payloads of at least ``REVISIT_BYTES`` the largest page_id is a response
and the others are revisits that refer to it; smaller payloads are always responses.

Index: captures are sorted by the URL's key (its host reversed: ``org,example)/path``) and page_id, and written as
lines into zlib blocks of ``BLOCK_LINES``, a file for each key range; the second level, a directory at the file's
end, has only the first and last key and the place of each block. Lookup: a key is binary-searched among the files
and in the directory, its block is read by one range read and binary-searched for the line, and the line names the
range of the archive to read. Lookups of a task come in key order and record reads in archive order, so blocks and
files are opened once each.

Files are written under a name that no other attempt uses and are listed by the table of captures, itself written
by Spark, so a repeated or lost task leaves at most an unlisted file. The folder can be in any store that
``pyarrow.fs`` opens.

Defined results: null html is an empty payload; a null or malformed URL has the key of its text; rows with equal
URLs are kept apart by page_id, and repeated rows come back as often as they went in; a null page_id is never the
response that others refer to while there is an id; an empty table gives an empty table. Other columns take no part.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import joined_evenly, new_path, remove, shuffle_partitions, table, written, written_at

REVISIT_BYTES = 1_000
BLOCK_LINES = 256
LEVEL = 3
#: Pages have no date of capture.
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"
_URL = re.compile(r"(?is)\A[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")


def reversed_host_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme, user, ``www.`` and fragment dropped."""
    m = _URL.match(url or "")
    if not m or not m[1]:
        return url or ""
    host = m[1].lower().rstrip(".").removeprefix("www.")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{','.join(reversed(host.split('.')))}{port}){m[3] or '/'}"


def record_id(page_id: int | None) -> str:
    """A record's URI, made from the page's id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


#: The HTTP head of a page; pages come without the one they were sent with.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def member(head: list[str], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    lines = ["WARC/1.1", *head, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def warcinfo(name: str) -> bytes:
    """The record that an archive file begins with."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return member(head, b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n")


def record(page: dict, payload: bytes) -> bytes:
    """A page's record: an HTTP response with its payload. A revisit holds the HTTP head only, and the payload's digest and size."""
    digest = hashlib.sha1(payload).hexdigest()
    revisit = page["record_type"] == "revisit"
    head = [
        f"WARC-Type: {page['record_type']}",
        f"WARC-Record-ID: {record_id(page['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', page['url'] or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        f"X-Page-ID: {'' if page['page_id'] is None else page['page_id']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(page['refers_to'])}", f"X-Refers-To-Page-ID: {page['refers_to']}"]
    return member(head, HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload))


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a page's record, of a revisit nothing; the block's size is checked."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("a broken record")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


class Store:
    """Files below a folder of the shared store, by name."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.open_files: dict[str, object] = {}

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        """A range of a file; the file stays open for the next range."""
        if name not in self.open_files:
            for f in self.open_files.values():
                f.close()
            self.open_files = {name: self.fs.open_input_file(f"{self.root}/{name}")}
        return self.open_files[name].read_at(length, offset)


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, record_type, refers_to: which record each page becomes.

    What meets by digest are ids of large payloads, without their html; revisits then meet their pages by id and digest.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1("html")))
    large = p.where("digest is not null").select("page_id", "digest")
    response = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    revisit = joined_evenly(large, response, "digest").where(~F.col("page_id").eqNullSafe(F.col("response"))).distinct()
    revisit = written(revisit.select(F.col("page_id").alias("i"), F.col("digest").alias("d"), "response"), "revisits")
    typed = p.join(revisit, F.col("page_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    return typed.select("page_id", "url", "html", F.when(F.col("response").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("response").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the table of captures (written, so that tasks run once)."""

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, name, out, offset = Store(folder), f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for i, url, html, kind, to in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["record_type"], batch["refers_to"].astype("Int64")):
                page = {"page_id": None if i is pd.NA else int(i), "url": url if isinstance(url, str) else None, "record_type": kind, "refers_to": None if to is pd.NA else int(to)}
                data = record(page, html.encode())
                if out is None:
                    out, first = store.create(name), warcinfo(name)
                    out.write(first)
                    offset = len(first)
                out.write(data)
                rows.append((reversed_host_key(page["url"]), page["page_id"], name, offset, len(data)))
                offset += len(data)
            if rows:
                yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return written(pages.mapInPandas(archive, CAPTURE), "captures")


NULL_ID = -(1 << 63)
PART = "first_key string, first_id bigint, last_key string, last_id bigint, file string, directory_offset bigint, directory_length bigint"


def _packed(lines: list) -> bytes:
    return zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), LEVEL)


def _unpacked(data: bytes) -> list:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def write_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Writes the index, one file for each key range: blocks of capture lines, then the file's directory.

    Returns the files with their first and last keys, as many as shuffle partitions, in key order. A hot key is
    spread over ranges by its pages' ids.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, name, out, offset, lines, directory = Store(folder), f"index-{uuid.uuid4().hex}.zl", None, 0, [], []

        def flush() -> None:
            nonlocal out, offset, lines
            data = _packed(lines)
            out = store.create(name) if out is None else out
            out.write(data)
            directory.append((*lines[0][:2], *lines[-1][:2], offset, len(data)))
            offset, lines = offset + len(data), []

        for batch in batches:
            for key, i, file, at, n in zip(batch["key"], batch["page_id"].astype("Int64"), batch["file"], batch["offset"], batch["length"]):
                lines.append((key, NULL_ID if i is pd.NA else int(i), file, int(at), int(n)))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = _packed(directory)
            out.write(data)
            out.close()
            yield pd.DataFrame([(*directory[0][:2], *directory[-1][2:4], name, offset, len(data))], columns=[c.split()[0] for c in PART.split(", ")])

    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), *order).sortWithinPartitions(*order)
    path = new_path(captures.sparkSession, "index")
    parts = sorted(tuple(r) for r in written_at(ranged.mapInPandas(part, PART), path).collect())
    remove(captures.sparkSession, path)
    return parts


class Index:
    """Looks captures up: binary search for the file, in its directory, and in the block that one range read gets."""

    def __init__(self, parts: list[tuple], folder: str) -> None:
        self.parts, self.lasts, self.store = parts, [p[2:4] for p in parts], Store(folder)
        self.held_part = self.held_block = None

    def directory(self, p: int) -> list[list]:
        if p != self.held_part:
            *_, file, offset, length = self.parts[p]
            self.blocks, self.held_part = _unpacked(self.store.read(file, offset, length)), p
        return self.blocks

    def block(self, p: int, k: int) -> list[list]:
        if (p, k) != self.held_block:
            *_, offset, length = self.directory(p)[k]
            self.lines, self.held_block = _unpacked(self.store.read(self.parts[p][4], offset, length)), (p, k)
        return self.lines

    def find(self, key: str, page_id: int) -> Iterator[list]:
        """Capture lines (key, id, file, offset, length) of a page at a key."""
        wanted = (key, page_id)
        p = bisect_left(self.lasts, wanted)
        while p < len(self.parts) and self.parts[p][:2] <= wanted:
            blocks = self.directory(p)
            k = bisect_left(blocks, list(wanted), key=lambda b: b[2:4])
            while k < len(blocks) and tuple(blocks[k][:2]) <= wanted:
                lines = self.block(p, k)
                at = bisect_left(lines, list(wanted), key=lambda x: x[:2])
                while at < len(lines) and tuple(lines[at][:2]) == wanted:
                    yield lines[at]
                    at += 1
                k += 1
            p += 1


def looked_up(pages: DataFrame, parts: list[tuple], folder: str) -> DataFrame:
    """(page_id, file, offset, length): the captures of the pages' URLs and ids, found through the index in key order."""

    @F.pandas_udf("string")
    def key_of(batch: pd.Series) -> pd.Series:
        return pd.Series([reversed_host_key(u if isinstance(u, str) else None) for u in batch], dtype=object)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(parts, folder)
        for batch in batches:
            rows = []
            for key, i in zip(batch["key"], batch["page_id"].astype("Int64")):
                own = [(i, *line[2:]) for line in index.find(key, NULL_ID if i is pd.NA else int(i))]
                if not own:
                    raise KeyError(f"no capture of {key}")
                rows += own
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    wanted = pages.select(key_of("url").alias("key"), F.col("page_id").cast("bigint").alias("page_id")).distinct()
    ranged = wanted.repartitionByRange(shuffle_partitions(pages.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInPandas(found, "page_id bigint, file string, offset bigint, length bigint")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Range-reads the records in archive order: payload_bytes, digest, type and reference of each."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(folder)
        for batch in batches:
            rows = []
            for i, file, offset, length in zip(batch["page_id"].astype("Int64"), batch["file"], batch["offset"], batch["length"]):
                headers, block = parsed(store.read(file, int(offset), int(length)))
                digest, size, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Bytes"]), headers["WARC-Type"]
                if headers["X-Page-ID"] != ("" if i is pd.NA else str(int(i))):
                    raise ValueError("the index led to another page's record")
                if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                    raise ValueError("a payload that doesn't match its digest")
                rows.append((i, size, digest, kind, int(headers["X-Refers-To-Page-ID"]) if kind == "revisit" else None))
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = places.repartition(shuffle_partitions(places.sparkSession), "file", F.floor(F.col("offset") / (1 << 24))).sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives and index of ``pages`` (page_id, url, html) and reads every page back through them."""
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = write_archives(with_types(pages), folder)
    return read_records(looked_up(pages, write_index(captures, folder), folder), folder)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to
FROM r
"""
