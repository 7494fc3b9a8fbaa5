"""Object-path expressions. Paths are strings handed to the Hadoop file system."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Published versions of a bill, most wanted first, and its file name.
BILL_VERSIONS = ("ih", "enr", "eh", "rfs", "rs")
BILL_FILE = r"BILLS-118hr(\d+)([a-z]+)\.pdf$"


def path_parts(path: Column) -> Column:
    """struct(user_id, doc_id, filename) of ``.../raw/<user>/<doc>/.../<file>``.

    Without a complete ``raw`` section the user is unknown and the document is
    named by the parent folder.
    """
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "gs:"))
    n = F.size(parts)
    raw = F.array_position(parts, "raw").cast("int")
    complete = (raw > 0) & (n >= raw + 2)
    unknown = F.lit("unknown")
    return F.struct(
        F.when(complete, F.get(parts, raw)).otherwise(unknown).alias("user_id"),
        F.when(complete, F.get(parts, raw + 1))
        .otherwise(F.coalesce(F.get(parts, n - 2), unknown))
        .alias("doc_id"),
        F.coalesce(F.get(parts, n - 1), unknown).alias("filename"),
    )


def bill_number(path: Column) -> Column:
    return F.regexp_extract(path, BILL_FILE, 1)


def bill_version(path: Column) -> Column:
    return F.regexp_extract(path, BILL_FILE, 2)


def bill_version_rank(path: Column) -> Column:
    """1 for the most wanted version, 0 for an unknown one."""
    return F.array_position(F.array(*[F.lit(v) for v in BILL_VERSIONS]), bill_version(path))
