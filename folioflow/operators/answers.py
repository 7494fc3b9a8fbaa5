"""From hits to answers: context, citations, confidence, prompts, replies, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.messages import parse_answer
from folioflow.functions.text import citation_snippet
from folioflow.operators.embedding import ATTEMPTS, MAX_WAIT, MIN_WAIT, call_with_retry

Completer = Callable[[list[str]], list[str]]

ANSWER_PROMPT = """Use the document excerpts below to answer the question.

EXCERPTS
{context}

QUESTION
{query}

Rely on the excerpts alone and say so when they are not sufficient. Name the document
and page behind each statement and explain how you reached the conclusion.
Reply with one JSON object holding "answer", "reasoning", "confidence" (high, medium
or low) and "requires_clarification" (true or false).
"""

CLAUSE_PROMPT = """Study this contract clause.

CLAUSE
{clause}

Reply in JSON with its type, the parties, their obligations, dates and deadlines,
conditions and exceptions, and possible risks or unclear wording.
"""

COMPARE_PROMPT = """Compare two contract clauses.

FIRST CLAUSE
{clause_a}

SECOND CLAUSE
{clause_b}

Describe what they share, where they differ, whom each favours, where they conflict,
and what you would recommend.
"""


def _page(hits: DataFrame) -> Column:
    return F.col("page_number") if "page_number" in hits.columns else F.lit(None).cast("int")


def build_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered excerpts in rank order. A question has at most top_k hits."""
    hits = hits.withColumn("page", F.coalesce(_page(hits).cast("string"), F.lit("N/A")))
    block = F.concat(
        F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")),
        F.lit("\nSource: "), F.coalesce("doc_id", F.lit("unknown")), F.lit(", Page: "), F.col("page"), F.lit("\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n").alias("context")
    )


def citation_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "doc_id", "chunk_id",
        citation_snippet(F.col("text")).alias("text"),
        _page(hits).alias("page_number"),
        F.col("score").alias("confidence"),
    )


def build_citations(hits: DataFrame) -> DataFrame:
    """(query_id, citations): array of structs in rank order."""
    item = F.struct("doc_id", "chunk_id", "text", "page_number", "confidence")
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return citation_rows(hits).groupBy("query_id").agg(
        F.transform(ordered, lambda c: c["item"]).alias("citations")
    )


def answer_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Mean hit score per question, 0.0 without hits."""
    means = hits.groupBy("query_id").agg(
        F.avg("score").alias("mean"), F.count("*").alias("n")
    )
    return queries.select("query_id").join(means, "query_id", "left").select(
        "query_id",
        F.coalesce("mean", F.lit(0.0)).alias("confidence"),
        F.coalesce("n", F.lit(0)).alias("chunks_retrieved"),
    )


def fill_template(template: str, **values: Column) -> Column:
    """The template with ``{name}`` replaced; inserted text is never expanded again."""
    pieces, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))


def build_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, prompt) for every question; without hits the context is empty."""
    return queries.select("query_id", "query_text").join(contexts, "query_id", "left").select(
        "query_id",
        fill_template(
            ANSWER_PROMPT,
            context=F.coalesce("context", F.lit("")),
            query=F.col("query_text"),
        ).alias("prompt"),
    )


def clause_prompts(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", fill_template(CLAUSE_PROMPT, clause=F.col("text")).alias("prompt"))


def compare_prompts(pairs: DataFrame) -> DataFrame:
    """Prompts for (clause_a, clause_b) rows; other columns are kept."""
    prompt = fill_template(COMPARE_PROMPT, clause_a=F.col("clause_a"), clause_b=F.col("clause_b"))
    return pairs.withColumn("prompt", prompt).drop("clause_a", "clause_b")


def complete_prompts(
    prompts: DataFrame,
    provider: Callable[[], Completer],
    batch_size: int = 32,
    attempts: int = ATTEMPTS,
    min_wait: float = MIN_WAIT,
    max_wait: float = MAX_WAIT,
) -> DataFrame:
    """(query_id, raw, error): one reply per prompt from a pluggable chat model.

    Model settings (temperature 0.3, 1000 tokens, JSON replies) belong to the provider.
    A batch that fails for good gives a null reply and the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete = provider()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                n = part.num_rows
                try:
                    texts = part.column(1).to_pylist()
                    raw, error = call_with_retry(complete, texts, attempts, min_wait, max_wait), None
                    if len(raw) != n:
                        raise ValueError(f"provider returned {len(raw)} replies for {n} prompts")
                except Exception as exc:
                    raw, error = [None] * n, str(exc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(raw, pa.string()), pa.array([error] * n, pa.string())],
                    names=["query_id", "raw", "error"],
                )

    return prompts.select("query_id", "prompt").mapInArrow(
        run, "query_id string, raw string, error string"
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """Parsed replies; where the provider gave none, ``error`` is what it said instead."""
    reply = parse_answer(F.col("raw"))
    said = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    parsed = replies.select("query_id", reply.alias("reply"), said.alias("_said")).select("query_id", "reply.*", "_said")
    return parsed.withColumn("error", F.coalesce("_said", "error")).drop("_said")


def assemble_results(
    queries: DataFrame, hits: DataFrame, replies: DataFrame, model: str
) -> DataFrame:
    """One result per question: answer, citations, confidence, reasoning, metadata, status."""
    confidence = answer_confidence(queries, hits)
    parsed = parse_replies(replies)
    bounded = F.col("confidence").between(0.0, 1.0)
    return (
        queries.select("query_id", F.col("query_text").alias("query"))
        .join(parsed, "query_id", "left")
        .join(build_citations(hits), "query_id", "left")
        .join(confidence, "query_id", "left")
        .select(
            "query_id", "query", "answer",
            F.coalesce("citations", F.array()).alias("citations"),
            F.coalesce("reasoning", F.lit("")).alias("reasoning"),
            "confidence",
            F.create_map(
                F.lit("chunks_retrieved"), F.col("chunks_retrieved").cast("string"),
                F.lit("model"), F.lit(model),
            ).alias("metadata"),
            F.when(~bounded, "failed").otherwise(F.coalesce("status", F.lit("failed"))).alias("status"),
            F.when(~bounded, "confidence outside 0..1").otherwise(F.col("error")).alias("error"),
        )
    )
