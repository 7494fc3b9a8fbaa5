"""Deterministic identifiers, so that reruns and redeliveries are harmless."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the DNS name space of RFC 4122, as hex.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def point_id(chunk_id: Column) -> Column:
    """Version-5 UUID of the chunk id in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(chunk_id, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        F.lit("89ab").substr(variant, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat_ws("_", F.coalesce(doc_id, F.lit("unknown")), index)


def upload_doc_id(user_id: Column, filename: Column, upload_time: Column) -> Column:
    """``doc_`` + 32 hex digits (128 bits); equal uploads get equal ids."""
    key = F.concat_ws("\u0001", user_id, filename, upload_time.cast("string"))
    return F.concat(F.lit("doc_"), F.substring(F.sha2(key, 256), 1, 32))
