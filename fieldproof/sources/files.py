"""Photo files and tolerant readers for row files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldproof import rules


#: Contents that a task reads before it hands them on.
READ_AT_ONCE = 4 << 20
_SCANNED = "path string, filename string, rel_path string, bytes long, mtime timestamp, content binary"
_LISTED = "rel_path string, bytes long, mtime long"


def scan_files(spark: SparkSession, path: str, suffixes: list[str] = rules.PHOTO_SUFFIXES) -> DataFrame:
    """Files below the folder with one of the suffixes, in any letter case.

    The filter acts while listing. ``rel_path`` starts below the folder. Of a
    mounted folder the driver learns no more than the names of the folders right
    below it: tasks list them, deal the files out anew and read them, in bounded
    portions. Other stores go through Spark's own scan, which lists on the driver
    and reads bytes only if ``content`` is selected downstream.
    """
    folder = re.sub(r"^file:(//)?(?=/)", "", path)
    if folder.startswith("/") and os.path.isdir(folder):
        return _scan_mounted(spark, folder.rstrip("/") or "/", suffixes)
    globs = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "?*.{" + ",".join(globs) + "}")
    files = files.option("recursiveFileLookup", "true").load(path)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/") + "/"
    below = F.expr("substr(path, instr(path, root) + length(root))")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("root", F.lit(root)).select(
        "path", name.alias("filename"), below.alias("rel_path"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("mtime"), "content",
    )


def _shown(name: str) -> bool:
    """Names that Spark's scans do not skip."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _scan_mounted(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """``scan_files`` of a folder that the driver and all tasks see at the same place."""
    ends = tuple(f".{s.lower()}" for s in suffixes)

    def wanted(name: str) -> bool:
        return any(name.lower().endswith(e) and len(name) > len(e) for e in ends)

    def found(below: str, deep: bool) -> Iterator[tuple[str, int, int]]:
        inner = []
        with os.scandir(os.path.join(root, below)) as entries:
            for entry in entries:
                try:
                    if _shown(entry.name) and entry.is_dir():
                        inner.append(os.path.join(below, entry.name))
                    elif _shown(entry.name) and wanted(entry.name):
                        stat = entry.stat()
                        if stat.st_size:  # Spark's scans skip empty files
                            yield os.path.join(below, entry.name), stat.st_size, stat.st_mtime_ns // 1_000_000
                except FileNotFoundError:  # went in the meantime
                    pass
        for folder in inner if deep else ():
            yield from found(folder, True)

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for below, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files = found(below, deep)
                while some := list(islice(files, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.int64()))], ["rel_path", "bytes", "mtime"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "filename", "rel_path", "bytes", "mtime", "content"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        rows, held = [], 0

        def portion() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for rel_path, size, mtime in zip(*(c.to_pylist() for c in batch.columns)):
                path = os.path.join(root, rel_path)
                with open(path, "rb") as file:
                    rows.append((f"file:{path}", os.path.basename(path), rel_path, size, mtime * 1000, file.read()))
                held += size
                if held >= READ_AT_ONCE or len(rows) >= 10_000:
                    yield portion()
                    rows, held = [], 0
        if rows:
            yield portion()

    with os.scandir(root) as entries:
        folders = [("", False), *((e.name, True) for e in entries if _shown(e.name) and e.is_dir())]
    listed = spark.createDataFrame(folders, "below string, deep boolean").mapInArrow(list_folders, _LISTED)
    tasks = max(spark.sparkContext.defaultParallelism, len(folders) // 32)
    return listed.repartition(tasks).mapInArrow(read, _SCANNED)


@contextmanager
def packed_by_size(spark: SparkSession, open_cost: int = 1 << 16) -> Iterator[None]:
    """Scans that run inside deal small files to tasks by hundreds.

    Spark counts a file as 4 MB more than it holds, so a task gets a few dozen
    small files at most and a large folder becomes tens of thousands of tasks.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(open_cost))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines without blank and malformed ones (S3)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The malformed lines of the same file, for quarantine (S3)."""
    marked = T.StructType([*schema.fields, T.StructField("_rejected", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", marked, {"columnNameOfCorruptRecord": "_rejected"})
    return lines.filter(parsed["_rejected"].isNotNull()).select(F.col("value").alias("line"))


def number_or_null(name: str, kind: str = "double") -> Column:
    """Text as number, NULL where it is none."""
    return F.col(name).try_cast(kind)


def count_or_zero(name: str) -> Column:
    """Text as count; decimals are cut, anything else is 0."""
    return F.coalesce(F.col(name).try_cast("double").try_cast("bigint"), F.lit(0)).cast("bigint")


def flag(name: str) -> Column:
    """'true' in any letter case, otherwise false."""
    return F.lower(F.col(name)) == "true"


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with header, every cell text, empty cells kept as ''."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).options(header=True, escape='"', multiLine=False).csv(path)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def read_verdicts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Typed verdict rows."""
    rows = read_text_csv(spark, path, columns)
    return rows.withColumns({
        "length_m": number_or_null("length_m"), "photo_count": count_or_zero("photo_count"),
        "compliant_photo_count": count_or_zero("compliant_photo_count"),
        "max_gap_m": number_or_null("max_gap_m"),
        "density_photos_per_5m": number_or_null("density_photos_per_5m"),
    })


def read_locations(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Typed location rows."""
    rows = read_text_csv(spark, path, columns)
    numbers = ["lat", "lon", "segment_t", "snap_distance_m"]
    return rows.withColumns({
        **{c: number_or_null(c) for c in numbers}, "latlon_vs_address_flag": flag("latlon_vs_address_flag"),
    })
