"""WARC archives and their two-level capture index.

Archives: each task writes its records as gzip members into files of the shared folder and returns where they
are; a file counts only if a finished task named it, so a lost executor leaves nothing that is read. Records with
equal payloads (by SHA-1) are stored once: the one with the largest page id is a response, the others are
revisits that name it.

Index: captures are range-sorted by (reversed-host URL key, page id, payload SHA-1) into parts; captures that share all
three hold the same payload and the same kind of record. A part is one file of compressed
blocks of ``BLOCK`` sorted lines, and a sparse directory with the first key and the byte range of each block.
A lookup finds its part among the parts' first keys, its block by binary search in that part's directory, and reads
one byte range of the index and one of the archive. There is a bounded number of parts, so what a task opens
(a directory, a block) is small too. Where one URL fills many parts, page ids and payloads split it.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import map_arrow, shared_folder, slices, stored

BLOCK = 512  #: captures of an index block
PART = 8_192  #: captures of an index part, about, up to ...
MAX_PARTS = 20_000  #: ... so many parts, which then grow: what the driver knows of the index is bounded
FILE_BYTES = 1_000_000_000
_END = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels reversed, lower case, without a leading www; then the path and query: com,example)/a?b."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return f"){url}"
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP headers but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
        "WARC-Target-URI": "".join((url or "").splitlines()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page is None else str(page),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["X-Refers-To-Page-ID"] = str(refers_to)
    fields["Content-Length"] = str(len(block))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END, 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode().split("\r\n")[1:]
        return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)

    head, _, rest = zlib.decompress(member, 31).partition(_END)
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(_END)
    return warc, fields(http), payload


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Spark path, from any process."""
    place = uri if "://" in uri else uri.removeprefix("file:")
    place = "file://" + place if place.startswith("/") else place
    return fs.FileSystem.from_uri(place)


class Writer:
    """Bytes into numbered files of a folder, each with a name of its own for every attempt."""

    def __init__(self, folder: str, suffix: str, limit: int = FILE_BYTES):
        self.files, self.root = opened(folder)
        self.folder, self.suffix, self.limit, self.stream, self.at = folder, suffix, limit, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at + len(data) > self.limit:
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.files.create_dir(self.root, recursive=True)
            path = posixpath.join(self.root, self.name)
            self.stream, self.at = self.files.open_output_stream(path, compression=None), 0
        self.stream.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class Reader:
    """Byte ranges of a folder's files; a few stay open."""

    def __init__(self, folder: str):
        self.files, self.root = opened(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) > 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(posixpath.join(self.root, name))
        return self.open[name].read_at(length, offset)


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """Write every page's record; (page, key, sha, file, offset, length) of each, stored. Null html is an empty payload;
    payloads of fewer than ``least_bytes`` are always responses, and so are equal ones if no page of them has a number to refer to."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # a payload that a third of all pages share is one row of this; the join splits what it meets (adaptive skew join)
    large = F.octet_length("payload") >= least_bytes
    winners = rows.where(large).groupBy("sha").agg(F.max("page").alias("winner"), F.count("*").alias("n"))
    winners = winners.where("n > 1").select("sha", "winner")
    told = rows.join(winners, "sha", "left")
    refers = F.when(large & F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page")), F.col("winner"))
    told = told.select("page", "url", "payload", "sha", refers.alias("refers_to"))

    def write(batches):
        out = Writer(folder, ".warc.gz")
        for batch in slices(batches, "payload"):
            places = []
            for number, address, payload, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                places.append((number, url_key(address), sha, *out.add(record(number, address, payload, digest, refers_to))))
            kinds = (batch.schema.field("page").type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(zip(*places), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page", "key", "sha", "file", "offset", "length"])
        out.close()

    schema = f"page {dict(pages.dtypes)[page]}, key string, sha string, file string, offset bigint, length bigint"
    return stored(map_arrow(told, write, schema), "warc-captures")


#: Stands for a null page id in the index: less than any id can be.
NO_PAGE = -(2**63) - 1


@dataclass(frozen=True)
class Index:
    """Where the parts are: their first (key, page, sha), and the file, offset and length of each part's directory."""

    folder: str
    bounds: list[tuple[str, int, str]]
    directories: dict[int, tuple[str, int, int]]

    def part_of(self, key: str, page: int | None, sha: str) -> int:
        return bisect.bisect_right(self.bounds, (key, NO_PAGE if page is None else page, sha))


def cuts(captures: DataFrame) -> list[tuple[str, int, str]]:
    """First (key, page, sha) of all parts but the first, as quantiles of a random sample of bounded size. They only
    balance the parts; every capture is placed by them, whatever the sample."""
    rows = captures.count()
    parts = min(MAX_PARTS, -(-rows // PART))
    if parts < 2:
        return []
    sample = captures.sample(min(1.0, 100 * parts / rows), seed=7).select("key", "page", "sha")
    found = sorted((r["key"], NO_PAGE if r["page"] is None else r["page"], r["sha"]) for r in sample.collect())
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def write_index(captures: DataFrame, folder: str) -> Index:
    bounds = cuts(captures)
    empty = Index(folder, bounds, {})

    def place(batches):
        for batch in batches:
            captured = zip(*(batch.column(c).to_pylist() for c in ("key", "page", "sha")))
            part = pa.array([empty.part_of(*c) for c in captured], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", *batch.schema.names])

    kind = dict(captures.dtypes)["page"]
    schema = f"part int, page {kind}, key string, sha string, file string, offset bigint, length bigint"
    dealt = map_arrow(captures, place, schema).repartitionById(len(bounds) + 1, F.col("part"))
    rows = dealt.sortWithinPartitions("part", "key", F.asc_nulls_first("page"), "sha")

    def write(batches):
        out, directory, held, at, finished = Writer(folder, ".cdx.gz"), [], [], None, []

        def close_block():
            if held:
                lines = "\n".join(json.dumps(x, separators=(",", ":")) for x in held)
                directory.append([*held[0][:3], *out.add(zlib.compress(lines.encode()))])
                held.clear()

        def close_part():
            close_block()
            if directory:
                finished.append((at, *out.add(zlib.compress(json.dumps(directory).encode()))))
                directory.clear()

        for batch in batches:
            for part, page, key, sha, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    close_part()
                    at = part
                if len(held) == BLOCK:
                    close_block()
                held.append((key, NO_PAGE if page is None else page, sha, file, offset, length))
        close_part()
        out.close()
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(zip(*finished) if finished else [()] * 4, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "file", "offset", "length"])

    found = stored(map_arrow(rows, write, "part int, file string, offset bigint, length bigint"), "warc-directories")
    return Index(folder, bounds, {r["part"]: (r["file"], r["offset"], r["length"]) for r in found.collect()})  # MAX_PARTS rows


def lookup(wanted: DataFrame, index: Index, archives: str) -> DataFrame:
    """Records of the wanted (url, page, sha) captures, read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A capture that the index does not have gives no row."""
    shared = wanted.sparkSession.sparkContext.broadcast(index)

    def keyed(batches):
        for batch in batches:
            keys = [url_key(u) for u in batch.column("url").to_pylist()]
            captured = zip(keys, batch.column("page").to_pylist(), batch.column("sha").to_pylist())
            part = [shared.value.part_of(*c) for c in captured]
            arrays = [pa.array(part, pa.int32()), pa.array(keys, pa.string()), batch.column("page"), batch.column("sha")]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "key", "page", "sha"])

    kind = dict(wanted.dtypes)["page"]
    asked = map_arrow(wanted.select("url", "page", "sha"), keyed, f"part int, key string, page {kind}, sha string")
    rows = asked.repartitionById(len(index.bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "page", "sha")

    def read(batches):
        cdx, warc = Reader(index.folder), Reader(archives)
        at, directory, block_at, block = None, [], None, []
        for batch in batches:
            out = []
            for part, key, page, sha in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    place = shared.value.directories.get(part)
                    directory = json.loads(zlib.decompress(cdx.range(*place))) if place else []
                    at, block_at = part, None
                me = [key, NO_PAGE if page is None else page, sha]
                k = bisect.bisect_right(directory, me, key=lambda x: x[:3]) - 1
                if k < 0:
                    continue
                if k != block_at:
                    lines = zlib.decompress(cdx.range(*directory[k][3:])).decode().split("\n")
                    block, block_at = [json.loads(x) for x in lines], k
                i = bisect.bisect_left(block, me, key=lambda x: x[:3])
                if i < len(block) and block[i][:3] == me:
                    out.append((page, *described(warc.range(*block[i][3:]))))
            columns = zip(*out) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return map_arrow(rows, read, schema)


def described(member: bytes) -> tuple[int, str, str, int | None]:
    """payload_bytes, payload_digest, record_type, refers_to of a record. A response's payload is hashed again."""
    fields, http, payload = parsed(member)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http["Content-Length"])
    if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload read back differs from what was written")
    refers_to = fields.get("X-Refers-To-Page-ID")
    return size, digest, kind, int(refers_to) if refers_to else None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, index the archives, look every page up and read its record back.

    Null html is an empty payload; a null url has a key of its own. Every row comes back once with its own payload,
    also under a null or repeated (url, page_id). An empty table gives an empty result; other columns are ignored.
    """
    archives, index = (shared_folder(pages.sparkSession, p) for p in ("warc-archives", "warc-index"))
    captures = write_archives(pages, archives)
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    wanted = pages.select("url", F.col("page_id").alias("page"), sha.alias("sha"))
    return lookup(wanted, write_index(captures, index), archives)
