"""WARC archives: written with an index of byte ranges, read back by coalesced ranges of the selected records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import exchange_width, fresh_path, salted_join, write_once

_INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Ranges this near to each other are read at once, up to so many bytes.
NEAR_BYTES = 64 << 10
READ_BYTES = 8 << 20

_CONTROL = re.compile("[\\x00-\\x20\\x7f]")


def target_uri(url: str | None) -> str:
    """The address as it stands; only what would break a header line, blanks and control characters, is percent-encoded."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member that holds one WARC/1.1 record: a revisit if it refers to another page, else a response."""
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogateescape") + body + b"\r\n\r\n", 6, mtime=0)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    whole = gzip.decompress(member)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at this place: {version[:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(headers["Content-Length"])]
    if len(body) != int(headers["Content-Length"]) or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a WARC record is shorter than its header says")
    return headers, body


def payload_of(column: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def revisits(slim: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload a smaller page_id has too, each once. Payloads are not read."""
    slim = slim.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    many = write_once(groups, "warc-groups")
    found = salted_join(slim, many.select("digest", "refers_to"), "digest", "page_id", counts=many)
    return found.where(F.col("page_id") != F.col("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write one archive a task into the shared folder and return the index: a row a record with its archive and byte range.

    A task that is tried again writes another archive; the index names those of the tries that counted. Payloads are equal
    if their SHA-256 is. ``date`` is the capture date of all records, by default the time of writing.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    captured = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload_of(html_col).alias("payload"))
    digested = slim.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    known = revisits(digested.select("page_id", "digest", F.octet_length("payload").alias("n")), min_bytes)
    # by id and digest: rows that share an id may differ in payload; rows without an id are responses, and join with nothing
    named = digested.where("page_id is not null").join(known, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    joined = named.unionByName(digested.where("page_id is null").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, f"part-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member = record(page_id, url, payload, digest, refers_to, captured)
                out.write(member)
                rows.append((page_id, url, len(payload), digest, "response" if refers_to is None else "revisit", refers_to, name, at, len(member)))
                at += len(member)
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in _INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out is not None:
            out.close()

    index = write_once(map_arrow(joined, run, _INDEX), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(folder + "/"), F.col("archive")))


def ranges(rows: list[tuple[int, int]], near: int = NEAR_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Coalesce (offset, length) in rising order into reads: (first row, end row, offset, bytes)."""
    out: list[tuple[int, int, int, int]] = []
    for k, (at, n) in enumerate(rows):
        if out and at - (out[-1][2] + out[-1][3]) <= near and at + n - out[-1][2] <= most:
            first, _, begin, _ = out[-1]
            out[-1] = (first, k + 1, begin, max(out[-1][3], at + n - begin))
        else:
            out.append((k, k + 1, at, n))
    return out


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records that ``index`` selects, archive by archive in byte order, and check each against its header and digest."""

    def one_archive(store: fs.FileSystem, path: str, rows: list[tuple]) -> Iterator[tuple]:
        with store.open_input_file(path) as source:
            for first, end, begin, size in ranges([r[:2] for r in rows]):
                block = source.read_at(size, begin)
                for at, n, page_id, url in rows[first:end]:
                    headers, body = parse(block[at - begin : at - begin + n])
                    if headers["WARC-Record-ID"] != _record_id(page_id) or headers["WARC-Target-URI"] != target_uri(url):
                        raise ValueError(f"the index names page {page_id} at {url}, the archive {headers['WARC-Record-ID']} at {headers['WARC-Target-URI']}")
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"the payload of page {page_id} differs from its digest")
                    size_said = len(body) if kind == "response" else int(headers["WARC-Payload-Length"])
                    refers = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    yield page_id, url, size_said, digest, kind, int(refers) if refers else None, body if with_payload and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in _READ.split(", ")]

        def flush(archive: str | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                store, path = fs.FileSystem.from_uri(archive)
                made: list[tuple] = []
                for made_row in one_archive(store, path, rows):
                    made.append(made_row)
                    if len(made) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)
                        made = []
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

        archive, rows = None, []
        for batch in batches:
            for name, at, n, page_id, url in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if name != archive:
                    yield from flush(archive, rows)
                    archive, rows = name, []
                rows.append((at, n, page_id, url))
        yield from flush(archive, rows)

    slim = index.select("archive", "offset", "length", "page_id", "url")
    dealt = slim.repartition(exchange_width(index.sparkSession), "archive").sortWithinPartitions("archive", "offset")
    return map_arrow(dealt, run, _READ)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, then read all records back through the index.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is a response and the
    others revisit it. A null html is an empty payload, a null url an empty one; rows that share page_id and payload are
    all responses, if theirs is the smallest, and rows that share a page_id alone are judged each by its payload; a null page_id never revisits nor is revisited. An empty table gives an
    empty one. Other columns are not read. Very long payloads are one record each.
    """
    return read_records(write_archives(pages, id_col, url_col, html_col, min_bytes), with_payload=False).drop("payload")
