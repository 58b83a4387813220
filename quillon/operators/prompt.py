"""Prompts from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.columns import citation

#: Fixed formats.
TEMPLATE = "Use the following context to answer the question.\n\nContext:\n{context}\n\nSources:\n{sources}\n\nQuestion: {query}\n"
CHUNK = "[{i}] {text}\n"


def chunk_texts(results: DataFrame, chunk: str = CHUNK, sources: bool = True) -> DataFrame:
    """rank, chunk, source for results with rank from 1; templates hold {i} and {text}."""
    cite = citation(F.col("metadata"), F.col("id"))
    body: Column = F.replace(F.lit(chunk), F.lit("{i}"), F.col("rank").cast("string"))
    # the text goes in last, so that braces in it are left alone
    body = F.replace(body, F.lit("{text}"), F.coalesce("text", F.lit("")))
    if sources:
        body = F.concat(body, F.lit("(source: "), F.coalesce(cite, F.lit("")), F.lit(")\n"))
    return results.select("rank", body.alias("chunk"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cite).alias("source"))


def assembled(results: DataFrame, chunk: str = CHUNK, sources: bool = True) -> DataFrame:
    """One row: context and sources, in the order of the ranks."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "chunk", "source")))
    rows = chunk_texts(results, chunk, sources).agg(parts.alias("p"))
    listed = F.array_join(F.col("p.source"), "\n") if sources else F.lit("")
    return rows.select(F.array_join(F.col("p.chunk"), "\n").alias("context"), F.when(F.length(listed) > 0, listed).otherwise("(none)").alias("sources"))


def prompt(query: str, results: DataFrame, template: str = TEMPLATE, chunk: str = CHUNK, sources: bool = True) -> str:
    row = assembled(results, chunk, sources).first()
    return template.format(context=row["context"], sources=row["sources"], query=query)


def results_only(results: DataFrame, chunk: str = CHUNK) -> str:
    return assembled(results, chunk, False).first()["context"]
