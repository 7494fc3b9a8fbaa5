"""Clause-aware, fixed-size and recursive chunking.

A document is cut inside its own row and exploded last, so chunking needs no
shuffle and a user or source with very many documents is no special case.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import ids
from folioflow.functions.text import SPACE, SPACE_CHARS, count_at_most, running_sums, strip

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50

# What starts a clause. The classes follow Python's \s and \d. The group is possessive,
# which matches the same texts: Java's matcher would recurse once for each part of a long dotted number.
DIGIT = r"\p{Nd}"
MARKER = (
    rf"(?:{DIGIT}+\.(?:{DIGIT}+\.?)*+|\(?[a-z]\)"
    rf"|Article[{SPACE}]+{DIGIT}+|Section[{SPACE}]+{DIGIT}+)"
)
CLAUSE = rf"(\n[{SPACE}]*{MARKER})"
HEADING = rf"(?:^|\n)[{SPACE}]*((?:Article|Section)[{SPACE}]+{DIGIT}+)"
# Separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", ".", ";")

# Two non-characters that no interchanged text holds; a text that does hold them
# takes the longer way below.
_MARK = "\ufdd0\ufdd1"


def split_clauses(text: Column) -> Column:
    """array<string>: the text cut before and after every clause marker, nothing lost."""
    marked = F.split(F.regexp_replace(text, CLAUSE, f"{_MARK}$1{_MARK}"), _MARK, -1)
    between = F.split(text, CLAUSE, -1)
    markers = F.regexp_extract_all(text, F.lit(CLAUSE), 1)
    zipped = F.flatten(F.transform(between, lambda p, i: F.array(p, F.get(markers, i))))
    return F.when(F.contains(text, F.lit(_MARK)), F.filter(zipped, lambda p: p.isNotNull())).otherwise(
        marked
    )


def _placed(text: Column, start: Column) -> Column:
    """struct(text, start) of a stripped text that began at ``start``."""
    return F.struct(
        strip(text).alias("text"), (start + F.length(text) - F.length(F.ltrim(text, F.lit(SPACE_CHARS)))).alias("start")
    )


def _clause_pieces(docs: DataFrame, size: int, places: bool = False) -> DataFrame:
    """Clause parts packed greedily up to ``size`` characters, as column ``pieces``.

    Only lengths decide where a chunk ends, so the fold carries integers: the first part
    of every chunk. The chunks are then joined from the parts in one go. A part longer
    than ``size`` stays whole; blank chunks are dropped. Each step reads the one before
    several times, which keeps Spark from evaluating a step more than once per row. With ``places``
    a piece is a struct of its text and the character it starts at.
    """
    none_yet = F.struct(F.lit(1).alias("part"), F.lit(0).alias("chars"), F.array(F.lit(1)).alias("starts"))

    def pack(acc: Column, chars: Column) -> Column:
        full = acc["chars"] + chars > size
        return F.struct(
            (acc["part"] + 1).alias("part"),
            F.when(full, chars).otherwise(acc["chars"] + chars).alias("chars"),
            F.when(full, F.array_append(acc["starts"], acc["part"])).otherwise(acc["starts"]).alias("starts"),
        )

    lengths = F.transform("parts", lambda p: F.length(p))
    starts = F.aggregate(lengths, none_yet, pack, lambda acc: F.array_append(acc["starts"], acc["part"]))

    def joined(start: Column, index: Column) -> Column:
        return F.array_join(F.slice("parts", start, F.get(F.col("starts"), index + 1) - start), "")

    first_parts = F.slice("starts", F.lit(1), F.size("starts") - 1)
    cut = docs.withColumn("parts", split_clauses(F.col("text"))).withColumn("starts", starts)
    if not places:
        pieces = F.filter(F.transform(first_parts, lambda s, i: strip(joined(s, i))), lambda p: p != "")
        return cut.withColumn("pieces", pieces)
    before = lambda part: F.coalesce(F.get("sums", part - 2), F.lit(0))
    pieces = F.transform(first_parts, lambda s, i: _placed(joined(s, i), before(s)))
    return cut.withColumn("sums", running_sums(lengths)).withColumn("pieces", F.filter(pieces, lambda p: p["text"] != ""))


_TEXTS_AT_ONCE = 64
_PLACED = pa.struct([("text", pa.string()), ("start", pa.int32())])


def _python_pieces(text: Column, cut: Callable[[str], Iterator[tuple[str, int]]], places: bool) -> Column:
    """The stripped, non-blank pieces that ``cut`` gives for a text with their starts."""

    def tidy(doc: str) -> list:
        found = ((p.strip(), at + len(p) - len(p.lstrip())) for p, at in cut(doc))
        return [{"text": p, "start": at} if places else p for p, at in found if p]

    kind = pa.list_(_PLACED if places else pa.string())

    @F.arrow_udf("array<struct<text:string,start:int>>" if places else "array<string>")
    def run(texts: pa.Array) -> pa.Array:
        # Pieces are Python objects for a few texts at a time only.
        parts = (texts.slice(i, _TEXTS_AT_ONCE).to_pylist() for i in range(0, len(texts), _TEXTS_AT_ONCE))
        made = [pa.array([tidy(t or "") for t in part], kind) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return run(text)


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, places: bool = False) -> Column:
    """array<string>: windows of ``size`` ending at the last ``.``, newline or ``?`` inside.

    Windows overlap by ``overlap`` unless that would not move forward, and the
    window that reaches the end of the text is the last one. With ``places`` structs of text and start.
    """

    def windows(doc: str) -> Iterator[tuple[str, int]]:
        stops = [m.end() for m in re.finditer(r"[.\n?]", doc)]
        begin = 0
        while begin + size < len(doc):
            last = bisect_right(stops, begin + size) - 1
            end = stops[last] if last >= 0 and stops[last] > begin else begin + size
            yield doc[begin:end], begin
            begin = end - overlap if end - overlap > begin else end
        yield doc[begin:], begin

    return _python_pieces(text, windows, places)


def recursive_chunks(
    text: Column,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
    places: bool = False,
) -> Column:
    """array<string>: split at the coarsest separator present, finer only where needed."""

    def pieces_of(doc: str, level: int) -> list[str]:
        while level < len(separators) and separators[level] not in doc:
            level += 1
        if len(doc) <= size or level == len(separators):
            return [doc]
        sep = separators[level]
        head, *tail = doc.split(sep)
        return [p for part in [head, *(sep + t for t in tail)] if part for p in pieces_of(part, level + 1)]

    def merged(doc: str) -> Iterator[tuple[str, int]]:
        window, length, begin = deque(), 0, 0
        for piece in pieces_of(doc, 0):
            if window and length + len(piece) > size:
                yield "".join(window), begin
                while window and (length > overlap or length + len(piece) > size):
                    gone = len(window.popleft())
                    length, begin = length - gone, begin + gone
            window.append(piece)
            length += len(piece)
        yield "".join(window), begin

    return _python_pieces(text, merged, places)


def _pieces(docs: DataFrame, mode: str, size: int, overlap: int, places: bool = False) -> DataFrame:
    if mode == "clause":
        return _clause_pieces(docs, size, places)
    cut = {"fixed": fixed_chunks, "recursive": recursive_chunks}[mode]
    return docs.withColumn("pieces", cut(F.col("text"), size, overlap, places=places))


def chunk_documents(
    docs: DataFrame,
    mode: str = "clause",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    links: bool = False,
    clause_meta: bool = False,
    pages: bool = False,
    before: bool = False,
) -> DataFrame:
    """One row per chunk of (doc_id, user_id, filename, text) documents.

    ``links`` adds prev_chunk_id / next_chunk_id, ``clause_meta`` adds clause_number,
    section_type and parent_section, ``pages`` adds page_number (of the chunk's first character, from the documents'
    ``page_ends``; null without) and ``before`` adds prev_text, the chunk before. All come from the document's own
    row. Clause mode has no overlap.
    """
    ends = F.col("page_ends") if "page_ends" in docs.columns else F.lit(None).cast("array<int>")
    docs = docs.select(
        F.coalesce("doc_id", F.lit("unknown")).alias("doc_id"), "user_id", "filename",
        F.coalesce("text", F.lit("")).alias("text"), *([ends.alias("ends")] if pages else []),
    )
    cut = _pieces(docs, mode, size, overlap, places=pages)
    text_of = (lambda p: p["text"]) if pages else (lambda p: p)
    fields = {}
    if clause_meta:
        cut = _with_headings(cut, text_of)
        fields["parent"] = lambda p, i: _parent_section(text_of(p), i)
    if pages:
        known = F.size(F.coalesce("ends", F.array())) > 0
        fields["page"] = lambda p, i: F.when(known, F.least(count_at_most(F.col("ends"), p["start"]) + 1, F.size("ends")))
    if before:
        fields["before"] = lambda p, i: F.when(i > 0, text_of(F.get("pieces", i - 1)))
    pieces = F.col("pieces")
    if fields:
        pieces = F.transform(
            pieces, lambda p, i: F.struct(text_of(p).alias("text"), *[make(p, i).alias(name) for name, make in fields.items()])
        )
    cut = cut.select("doc_id", "user_id", "filename", pieces.alias("pieces"))
    # The outer form on purpose: for a plain explode Spark adds a "size > 0" filter, pushes
    # it down to the scan and thereby chunks every document a second time.
    rows = cut.select(
        "doc_id", "user_id", "filename", F.size("pieces").alias("n"),
        F.posexplode_outer("pieces").alias("chunk_index", "piece"),
    ).filter("piece is not null")
    index = F.col("chunk_index")
    text = F.col("piece.text") if fields else F.col("piece")
    columns = [
        ids.chunk_id(F.col("doc_id"), index).alias("chunk_id"),
        "doc_id", "user_id", "filename", "chunk_index", text.alias("text"),
    ]
    if links:
        columns += [
            F.when(index > 0, ids.chunk_id(F.col("doc_id"), index - 1)).alias("prev_chunk_id"),
            F.when(index < F.col("n") - 1, ids.chunk_id(F.col("doc_id"), index + 1)).alias("next_chunk_id"),
        ]
    if clause_meta:
        clause = F.nullif(F.regexp_extract(text, f"^({MARKER})", 1), F.lit(""))
        columns += [
            clause.alias("clause_number"),
            F.when(clause.startswith("Article"), "article")
            .when(clause.startswith("Section"), "section")
            .when(clause.rlike(r"^\p{Nd}"), "numbered")
            .when(clause.isNotNull(), "lettered")
            .alias("section_type"),
            F.col("piece.parent").alias("parent_section"),
        ]
    if pages:
        columns.append(F.col("piece.page").alias("page_number"))
    if before:
        columns.append(F.col("piece.before").alias("prev_text"))
    return rows.select(*columns)


def _with_headings(cut: DataFrame, text_of: Callable[[Column], Column]) -> DataFrame:
    """``cut`` with ``headings``, the last heading of every chunk that has one, and ``headed``, the numbers of these chunks."""

    def last(piece: Column, index: Column) -> Column:
        found = F.regexp_extract_all(text_of(piece), F.lit(HEADING), 1)
        return F.struct(index.alias("at"), F.get(found, F.size(found) - 1).alias("name"))

    listed = F.filter(F.transform("pieces", last), lambda h: h["name"].isNotNull())
    return cut.withColumn("headings", listed).withColumn("headed", F.transform("headings", lambda h: h["at"]))


def _parent_section(piece: Column, index: Column) -> Column:
    """The Article/Section a chunk starts in: the heading it opens with, else the last one of earlier chunks."""
    opening = F.when(
        F.startswith(piece, F.lit("Article")) | F.startswith(piece, F.lit("Section")),
        F.nullif(F.regexp_extract(piece, f"^{HEADING}", 1), F.lit("")),
    )
    earlier = F.get("headings", count_at_most(F.col("headed"), index - 1) - 1)
    return F.coalesce(opening, earlier["name"])


def chunk_counts(
    docs: DataFrame, mode: str = "clause", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Documents to process and chunks they give, in one pass and without exploding them."""
    return _pieces(docs.select("text"), mode, size, overlap).agg(
        F.count("*").alias("docs"), F.coalesce(F.sum(F.size("pieces")), F.lit(0)).alias("chunks")
    )
