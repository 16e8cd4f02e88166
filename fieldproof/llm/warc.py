"""WARC records in ZIP packages: written per task, then read back by ranges.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.jsonl`` (a line per record with offset
and length inside the archive member). Reading parses the end record, the ZIP64
end record and the central directory, finds where the members' bytes lie in the
package, and reads runs of records by offset; nothing is extracted.

Packages lie below the shared folder. A task names its packages afresh in every
attempt and reports them only when it succeeds, so a lost executor leaves files
that no manifest names.

Defined cases: null html is an empty payload; of rows with equal payloads the one
with the smallest page_id is the response, the others are revisits; where several
have that page_id, one of the least url is it; null page_ids are revisits where the
group has an id, else responses; repeated rows are records of their own; a null url
gives no target; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof.session import cut_lineage, scratch_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: A task begins a new package beyond this many bytes; a read task takes so many records and bytes at once.
PACKAGE_BYTES, SLICE_RECORDS, READ_BYTES = 256 << 20, 500, 4 << 20
SLICES_PER_CORE = 8
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NONE = "none"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{_NONE if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    value = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == _NONE else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, whose length is the full payload's, and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page_id, payload bytes, payload digest, type, refers_to, payload (None for a revisit) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size, digest = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return _id(fields["warc-record-id"]), size, digest, "revisit", _id(fields["warc-refers-to"]), None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != digest or len(payload) != size:
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    return _id(fields["warc-record-id"]), size, digest, "response", None, payload


class _Package:
    """A ZIP file under construction; the records stream into the archive member."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        store, place = fs.FileSystem.from_uri(self.path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        self.file = store.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        coder = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = coder.compress(raw) + coder.flush()
        self.member.write(data)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(data)}))
        self.size += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.file.close()
        return self.path, len(self.index)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records) of the packages written below ``folder``, one record per page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    per_id = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    equal = cut_lineage(
        per_id.groupBy("digest").agg(least.alias("least"), F.sum("n").alias("n")).filter("n > 1")
        .select("digest", F.col("least.page_id").alias("first"), F.col("least.n").alias("ties"))
    )
    tie = F.coalesce((F.col("page_id") == F.col("first")) & (F.col("ties") > 1), F.lit(False))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    record_columns = ["page_id", "url", "payload", "first", "revisit"]
    usual = rows.join(equal, "digest", "left").filter(~tie).select("page_id", "url", "payload", "first", revisit.alias("revisit"))
    # Rows that share the smallest page_id: equal ones have no order, so they are counted and dealt out again.
    tied = rows.join(equal.filter("ties > 1"), "digest").filter(tie).groupBy("digest", "page_id", "url").agg(F.min("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    leader = rows.join(equal.filter("ties > 1"), "digest").filter(tie).groupBy("digest").agg(F.min(F.struct("url")).alias("leads"))
    again = (
        tied.join(leader, "digest").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("page_id", "url", "payload", F.col("page_id").alias("first"), (~F.col("url").eqNullSafe(F.col("leads.url")) | (F.col("i") > 1)).alias("revisit"))
    )
    chosen = usual.unionByName(again).select(*record_columns)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package: _Package | None = None

        def done() -> pa.RecordBatch:
            path, n = package.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in it:
            for page_id, url, data, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or _Package(folder)
                package.add(page_id, record(page_id, url, data, first, revisit))
                if package.size >= PACKAGE_BYTES:
                    yield done()
                    package = None
        if package:
            yield done()

    return chosen.mapInArrow(batches, "path string, records long")


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """(offset, length) in the package of every stored member.

    ``read(offset, length)`` gives bytes of the package. Sizes and offsets of
    0xFFFFFFFF come from the ZIP64 extra field, the directory's place from the
    ZIP64 end record where there is one.
    """
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end record")
    length, start = struct.unpack_from("<II", tail, at + 12)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        (record_at,) = struct.unpack_from("<Q", tail, at - 12)
        length, start = struct.unpack_from("<QQ", read(record_at, 56), 40)
    directory, found, at = read(start, length), {}, 0
    while at < len(directory):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        if method == 0:
            n_name_here, n_extra_here = struct.unpack_from("<HH", read(header, 30), 26)
            found[name] = (header + 30 + n_name_here + n_extra_here, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def records(path: str, low: int, high: int) -> Iterator[bytes]:
    """Records ``low`` to ``high`` of a package, read in runs of bounded size."""
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as file:
        read = lambda at, n: file.read_at(n, at)
        found = members(read, file.size())
        start, _ = found[ARCHIVE]
        entries = [json.loads(x) for x in read(*found[INDEX]).split(b"\n")[low:high]]
        while entries:
            run = 1
            while run < len(entries) and entries[run]["offset"] + entries[run]["length"] - entries[0]["offset"] <= READ_BYTES:
                run += 1
            base = entries[0]["offset"]
            data = read(start + base, entries[run - 1]["offset"] + entries[run - 1]["length"] - base)
            for e in entries[:run]:
                yield zlib.decompress(data[e["offset"] - base:e["offset"] - base + e["length"]], 31)
            entries = entries[run:]


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the packages in ``manifest`` (path, records), a slice of an index per row of work.

    page_id, payload_bytes, payload_digest, record_type, refers_to and payload
    (null for revisits, and everywhere without ``with_payload``).
    """
    step = F.lit(SLICE_RECORDS).cast("long")
    slices = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, step)).alias("low"))
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    # A fixed number of tasks: by size these few rows would fall to one.
    spread = slices.repartition(max(1, min(slices.count(), SLICES_PER_CORE * cores)), F.xxhash64("path", "low"))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, low in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for raw in records(path, low, low + SLICE_RECORDS):
                    row = parse(raw)
                    rows.append(row if with_payload else (*row[:5], None))
                    size += row[1]
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spread.mapInArrow(batches, _ROW)


def archive(pages: DataFrame) -> DataFrame:
    """The manifest (path, records) of ``pages`` packaged below the shared folder."""
    return cut_lineage(write(pages, scratch_path(pages.sparkSession, "packages")))
