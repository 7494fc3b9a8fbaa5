"""Small files beside the tables, through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    system, folder = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, place = file_system(spark, path)
    stream = system.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not exist yet: readers see all of it or nothing, and of two writers one fails."""
    jvm = spark.sparkContext._jvm
    system, place = file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}.{uuid.uuid4().hex}")
    stream = system.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    qualified = lambda p: p.makeQualified(system.getUri(), system.getWorkingDirectory())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(qualified(draft), qualified(place), no_overwrite)
    except Exception as e:
        system.delete(draft, False)
        raise FileExistsError(f"{path} was written by someone else") from e


def delete_folder(spark: SparkSession, path: str) -> None:
    system, folder = file_system(spark, path)
    system.delete(folder, True)
