"""Scans of raw uploaded files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.schemas import RAW_FILES
from folioflow.sources.files import file_system

# Rows and bytes of contents that a task holds at a time.
_LISTED_AT_ONCE, _READ_AT_ONCE, _BYTES_AT_ONCE = 10_000, 1024, 16 << 20
_STAMP = pa.timestamp("us", tz="UTC")


def arrow_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _root(spark: SparkSession, path: str, glob: str) -> str | None:
    """The qualified folder if tasks can list it themselves; None leaves it to Spark's reader."""
    if any(c in path for c in "*?[{") or any(c in glob for c in "{\\^"):
        return None
    system, place = file_system(spark, path)
    uri = place.makeQualified(system.getUri(), system.getWorkingDirectory()).toString().rstrip("/")
    try:
        arrow, inside = arrow_system(uri)
        known = arrow.get_file_info(inside).type == fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return None
    return uri if known else None


def scan_raw_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of every matching file below ``path``, by Spark's reader.

    ``content`` is only read when a later step selects it. The driver lists all files and makes a task of about 32 of
    them: for very many use ``read_files`` or ``list_files``.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def _listing(uri: str, glob: str, recursive: bool) -> Callable[[Iterator], Iterator]:
    """Lists folders (relative paths) in a task: their files, or without ``recursive`` their folders as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_system(uri)
        names = ["path", "modificationTime", "length", "folder"]
        types = [pa.string(), _STAMP, pa.int64(), pa.string()]
        for batch in batches:
            waiting = [name for name in batch.column(batch.schema.get_field_index("folder")).to_pylist()]
            while waiting:
                base = waiting.pop()
                rows = []
                for info in system.get_file_info(fs.FileSelector(f"{root}/{base}" if base else root)):
                    name = info.base_name
                    if name.startswith((".", "_")):  # hidden, as for Spark's readers
                        continue
                    below = f"{base}/{name}" if base else name
                    if info.type == fs.FileType.Directory:
                        if recursive:
                            waiting.append(below)
                        else:
                            rows.append((None, None, None, below))
                    elif fnmatchcase(name, glob):
                        rows.append((f"{uri}/{below}", info.mtime_ns // 1_000_000 * 1000, info.size, None))
                for i in range(0, len(rows), _LISTED_AT_ONCE):
                    columns = zip(*rows[i : i + _LISTED_AT_ONCE])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length) of every matching file below ``path``, contents unread.

    Tasks list the folders, so the driver holds no file name, however many files there are: one task the folder itself,
    then each folder in it with all below is dealt to some task. Patterns in ``path``, alternatives in ``glob`` and file
    systems that Arrow does not reach go through Spark's reader, which lists in the driver.
    """
    columns = ["path", "modificationTime", "length"]
    uri = _root(spark, path, glob)
    if uri is None:
        return scan_raw_files(spark, path, glob).select(*columns)
    row = "path string, modificationTime timestamp, length long, folder string"
    top = spark.range(1, numPartitions=1).select(F.lit("").alias("folder")).mapInArrow(_listing(uri, glob, False), row)
    folders = top.filter("folder is not null").select("folder").repartition(spark.sparkContext.defaultParallelism)
    below = folders.mapInArrow(_listing(uri, glob, True), row)
    return top.filter("folder is null").unionByName(below).select(*columns)


def _read_contents(uri: str) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_system(uri)

        def put(batch: pa.RecordBatch, start: int, contents: list[bytes]) -> pa.RecordBatch:
            part = batch.slice(start, len(contents))
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])

        for batch in batches:
            start, contents, held = 0, [], 0
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(f"{root}{path[len(uri):]}") as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= _BYTES_AT_ONCE or len(contents) == _READ_AT_ONCE:
                    yield put(batch, start, contents)
                    start, contents, held = start + len(contents), [], 0
            if contents:
                yield put(batch, start, contents)

    return run


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """What ``scan_raw_files`` gives, and empty files as well, from the listing of ``list_files``: dealt over the cluster.

    Without contents use ``list_files``.
    """
    uri = _root(spark, path, glob)
    if uri is None:
        return scan_raw_files(spark, path, glob)
    dealt = list_files(spark, path, glob).repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(_read_contents(uri), RAW_FILES)


def stream_raw_files(
    spark: SparkSession, path: str, glob: str = "*.pdf", max_files: int | None = None
) -> DataFrame:
    """The same scan as a stream; its checkpoint remembers the files seen.

    Spark's file stream keeps the names of all files in the driver. For very many files see ``jobs.poll_files``.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(RAW_FILES)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def file_manifest(files: DataFrame, prefix: str = "legal_documents/") -> DataFrame:
    """Name, target object key and size in KB of each file, without reading contents."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("filename"),
        F.concat(F.lit(prefix), name).alias("object_key"),
        F.round(F.col("length") / 1024, 1).alias("size_kb"),
    )
