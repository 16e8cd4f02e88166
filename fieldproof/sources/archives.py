"""Zip and tar uploads, opened inside tasks; one archive is one row."""

from __future__ import annotations

import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldproof import rules
from fieldproof.sources.features import parse_features, positions

_MEMBERS = "archive string, member_no int, member string, bytes long, content binary, error string"
_PARTS = "archive string, member_no int, tag string, member string, content binary, error string"
#: Rows and bytes handed back to Spark at a time.
_SHOW, _SHOW_BYTES = 64, 32 << 20
#: What damaged, encrypted or unknown archives and members raise.
_BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, EOFError, OSError)


def _suffix(name: str) -> str:
    return PurePosixPath(name).suffix.lower().lstrip(".")


def _is_sidecar(name: str) -> bool:
    path = PurePosixPath(name)
    return "__MACOSX" in path.parts or path.name.startswith("._") or path.name in (".DS_Store", "Thumbs.db")


def _zip_entries(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, lambda info=info: archive.open(info)


def _tar_entries(data: bytes):
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
        for info in archive:
            if info.isfile():
                yield info.name, info.size, lambda info=info: archive.extractfile(info)


def _read(opener, size: int, most_bytes: int | None) -> tuple[bytes | None, str | None]:
    """(content, error) of one member; ``most_bytes`` holds whatever the header says."""
    if most_bytes is not None and size > most_bytes:
        return None, "member too large"
    try:
        with opener() as handle:
            data = handle.read() if most_bytes is None else handle.read(most_bytes + 1)
    except _BROKEN as problem:
        return None, f"unreadable member: {type(problem).__name__}"
    return (data, None) if most_bytes is None or len(data) <= most_bytes else (None, "member too large")


_TAR_SUFFIXES = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz", ".tbz2", ".tar.xz", ".txz")


def _image_rows(name: str, data: bytes, most_members: int | None, most_bytes: int | None) -> Iterator[tuple]:
    """(member_no, member, bytes, content, error) of the images in one upload; a row for every member left out."""
    lower = name.lower()
    if not lower.endswith((".zip", *_TAR_SUFFIXES)):
        yield 0, name, len(data), data, None
        return
    count = 0
    try:
        for entry, size, opener in (_zip_entries if lower.endswith(".zip") else _tar_entries)(data):
            if _is_sidecar(entry) or _suffix(entry) not in rules.ARCHIVE_IMAGE_SUFFIXES:
                continue
            label = f"{name}/{PurePosixPath(entry).name}"
            if most_members is not None and count >= most_members:
                yield -1, label, size, None, "member limit reached"
                continue
            content, error = _read(opener, size, most_bytes)
            if error:
                yield -1, label, size, None, error
                continue
            yield count, label, len(content), content, None
            count += 1
    except _BROKEN as problem:
        yield -1, name, len(data), None, f"corrupt archive: {type(problem).__name__}"


def _in_chunks(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    chunk, held, content = [], 0, columns.index("content")
    for row in rows:
        chunk.append(row)
        held += len(row[content] or b"")
        if len(chunk) == _SHOW or held >= _SHOW_BYTES:
            yield pd.DataFrame(chunk, columns=columns)
            chunk, held = [], 0
    if chunk:
        yield pd.DataFrame(chunk, columns=columns)


def expand_archives(uploads: DataFrame, most_members: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Images inside uploads as rows; damaged or oversized ones become error rows.

    ``uploads`` has archive (name) and content. All members are taken unless a
    limit is given; one that is left out or can't be read is an error row, and
    the ones after it still come.
    """
    columns = ["archive", "member_no", "member", "bytes", "content", "error"]

    def run(batches):
        for batch in batches:
            rows = (
                (name, *row) for name, data in zip(batch["archive"], batch["content"])
                for row in _image_rows(name, bytes(data), most_members, most_bytes)
            )
            yield from _in_chunks(rows, columns)

    return uploads.select("archive", "content").mapInPandas(run, _MEMBERS)


def _geo_tag(name: str) -> str | None:
    base = PurePosixPath(name).name.lower()
    if base.endswith(".geojson"):
        for tag, hint in (("trenches", "trenches"), ("fcps", "fcp_polygons"), ("cluster", "sitecluster")):
            if hint in base:
                return tag
    return None


def _nested_rows(number: int, base: str, content: bytes, most_bytes: int | None) -> Iterator[tuple]:
    """Every geo file of a nested zip; the first per tag is chosen later."""
    try:
        for inner, size, opener in _zip_entries(content):
            tag = None if _is_sidecar(inner) else _geo_tag(inner)
            if tag:
                found, error = _read(opener, size, most_bytes)
                yield number, "skipped" if error else tag, PurePosixPath(inner).name, found, error
    except _BROKEN:
        yield number, "skipped", base, None, "corrupt nested zip"


def _part_rows(name: str, data: bytes, most_bytes: int | None) -> Iterator[tuple]:
    """(member_no, tag, member, content, error): geo files, nested ones unwrapped, and photos."""
    try:
        for number, (entry, size, opener) in enumerate(_zip_entries(data)):
            base = PurePosixPath(entry).name
            tag = _geo_tag(entry)
            nested = entry.lower().endswith("_geojson.zip")
            if _is_sidecar(entry) or not (tag or nested or _suffix(entry) in rules.ARCHIVE_IMAGE_SUFFIXES):
                continue
            content, error = _read(opener, size, most_bytes)
            if error:
                yield number, "skipped", base, None, error
            elif nested:
                yield from _nested_rows(number, base, content, most_bytes)
            else:
                yield number, tag or "photo", base if tag else f"{name}/{base}", content, None
    except _BROKEN:
        yield -1, "skipped", name, None, "corrupt archive"


def open_bundles(uploads: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Tagged members of lot bundles; the first file per geo tag counts."""
    columns = ["archive", "member_no", "tag", "member", "content", "error"]

    def run(batches):
        for batch in batches:
            rows = (
                (name, *row) for name, data in zip(batch["archive"], batch["content"])
                for row in _part_rows(name, bytes(data), most_bytes)
            )
            yield from _in_chunks(rows, columns)

    parts = uploads.filter(F.lower("archive").endswith(".zip")).select("archive", "content").mapInPandas(run, _PARTS)
    geo = parts.filter(F.col("tag").isin("trenches", "fcps", "cluster"))
    first = geo.groupBy("archive", "tag").agg(
        F.min(F.struct("member_no", "member", "content")).alias("m")
    ).select("archive", "m.member_no", "tag", "m.member", "m.content", F.lit(None).cast("string").alias("error"))
    return first.unionByName(parts.filter(~F.col("tag").isin("trenches", "fcps", "cluster")))


def lot_ids(parts: DataFrame) -> DataFrame:
    """Lot id from the archive name, else from the line file's name, else a default."""
    found = F.coalesce(*[
        F.nullif(F.regexp_extract(c, rules.LOT_ID_PATTERN, 1), F.lit("")) for c in ("archive", "member")
    ], F.lit("uploaded-lot"))
    return parts.filter("tag = 'trenches'").select("archive", found.alias("lot_id"))


def bundle_polygons(parts: DataFrame) -> DataFrame:
    """Zone and site rings per bundle; missing ones are the padded extent of its lines."""
    text = parts.withColumn("json", F.col("content").cast("string"))
    given = parse_features(text.filter(F.col("tag").isin("fcps", "cluster")), "json", ["archive", "tag"]).filter(
        "geometry_type = 'Polygon'"
    ).select("archive", "tag", "feature_no", "fcp_name",
             F.from_json("coordinates", "array<array<array<double>>>").alias("rings"), F.lit(False).alias("synthesised"))
    pad = F.lit(rules.BUNDLE_PAD_DEG)
    extent = (
        positions(parse_features(text.filter("tag = 'trenches'"), "json", ["archive"]), ["archive"])
        .groupBy("archive").agg(
            (F.min("x") - pad).alias("x1"), (F.max("x") + pad).alias("x2"),
            (F.min("y") - pad).alias("y1"), (F.max("y") + pad).alias("y2"))
    )
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1")]
    ring = F.array(F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners]))
    wanted = extent.withColumn("tag", F.explode(F.array(F.lit("fcps"), F.lit("cluster"))))
    missing = wanted.join(given.select("archive", "tag").distinct(), ["archive", "tag"], "left_anti").select(
        "archive", "tag", F.lit(0).alias("feature_no"), F.lit("F000").alias("fcp_name"), ring.alias("rings"),
        F.lit(True).alias("synthesised"))
    return given.unionByName(missing)
