"""Event messages (base64 JSON) and model replies (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from folioflow.schemas import UPLOAD_EVENT

PARSE_ERROR = "Failed to parse JSON"


def encode_event(**fields: Column) -> Column:
    body = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    # Spark breaks long base64 text into lines; messages travel as one.
    return F.translate(F.base64(F.encode(body, "utf-8")), "\r\n", "")


def decode_event(data: Column, schema: T.StructType = UPLOAD_EVENT) -> Column:
    """Struct of the message fields; a broken message gives a null struct."""
    body = F.try_to_binary(data, F.lit("base64"))
    return F.from_json(F.decode(body, "utf-8"), schema)


def parse_answer(raw: Column) -> Column:
    """struct(answer, reasoning, error, raw, status) of one model reply.

    Text that is not JSON keeps the raw reply beside an error; JSON without an
    ``answer`` cannot be used either and is marked failed.
    """
    parsed = F.try_parse_json(raw)
    answer = F.try_variant_get(parsed, "$.answer", "string")
    broken = parsed.isNull()
    return F.struct(
        answer.alias("answer"),
        F.coalesce(F.try_variant_get(parsed, "$.reasoning", "string"), F.lit("")).alias("reasoning"),
        F.when(broken, F.lit(PARSE_ERROR)).when(answer.isNull(), F.lit("'answer'")).alias("error"),
        F.when(broken, raw).alias("raw"),
        F.when(answer.isNull(), F.lit("failed")).otherwise(F.lit("success")).alias("status"),
    )
