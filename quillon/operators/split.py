"""Splitters: rows of documents (id, text, metadata) to rows of chunks (id, text, metadata, source_id, chunk_index).

A chunk's id is the hash of its text, so equal chunks share it. Null and blank texts give no chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import content_id, cosine, let, strip


def _spans(length: int, size: int, overlap: int, ends: list[int], width: int) -> Iterator[tuple[int, int]]:
    """(begin, stop) of the windows of a text longer than `size`. ends: where its separators of `width` characters end."""
    begin = 0
    while begin < length:
        stop = begin + size
        inside = bisect_right(ends, stop) if stop < length else 0
        if inside and ends[inside - 1] - max(overlap, width) > begin:
            stop = ends[inside - 1]
        yield begin, stop
        begin = stop - overlap


def character_windows(text: str, size: int, overlap: int, separator: str = "\n", drop_tail: bool = False) -> list[str]:
    """Windows of `size` characters, cut after the last whole separator inside if that moves the next window forward,
    else at full length; the next window begins `overlap` before the cut. A last window inside the one before it is
    kept unless `drop_tail`. Pieces are stripped, blank ones left out; a text that fits stays as it is."""
    if len(text) <= size:
        return [text] if text else []
    ends = [m.start() + len(separator) for m in re.finditer(f"(?={re.escape(separator)})", text)] if separator else []
    spans = list(_spans(len(text), size, overlap, ends, len(separator)))
    if drop_tail:
        spans = spans[: 1 + next(i for i, (_, stop) in enumerate(spans) if stop >= len(text))]
    return [piece for begin, stop in spans if (piece := text[begin:stop].strip())]


def _rows(documents: DataFrame, pieces: Column, method: str) -> DataFrame:
    base = documents.where(F.length(strip("text")) > 0)
    own = base.select("id", "metadata", pieces.alias("_pieces"))
    rows = own.select("id", "metadata", F.posexplode("_pieces").alias("chunk_index", "text"))
    extra = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("source_id"), F.col("id"), F.lit("split_method"), F.lit(method))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("chunk_index", "source_id", "split_method"))
    return rows.select(content_id("text").alias("id"), "text", F.map_concat(kept, extra).alias("metadata"), F.col("id").alias("source_id"), "chunk_index")


def split_characters(documents: DataFrame, size: int = 512, overlap: int = 64, separator: str = "\n", drop_tail: bool = False) -> DataFrame:
    """The recurrence is sequential within a text, so it runs in Arrow batches."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: character_windows(t, size, overlap, separator, drop_tail))

    return _rows(documents, cut("text"), "characters")


def token_windows(tokens: Column, text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens; the last one reaches the end. A text of at most `size` tokens stays as it is."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(size - overlap))).cast("int")))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i * (size - overlap) + 1, size), " "))
    return F.when(n <= size, F.array(text)).otherwise(joined)


def split_tokens(documents: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """By tokens between white space."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    tokens = F.split(strip("text"), r"(?U)\s+")
    return _rows(documents, let(tokens, lambda t: token_windows(t, F.col("text"), size, overlap)), "tokens")


def split_encoded(documents: DataFrame, load, size: int = 256, overlap: int = 32) -> DataFrame:
    """By the tokens of a tokenizer: load() runs once per worker and gives an object with encode and decode."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()

        def one(text: str) -> list[str]:
            ids = tokenizer.encode(text)
            ids = getattr(ids, "ids", ids)
            if len(ids) <= size:
                return [text]
            last = -(-(len(ids) - size) // (size - overlap))
            cuts = (tokenizer.decode(ids[i * (size - overlap) :][:size]).strip() for i in range(last + 1))
            return [c for c in cuts if c]

        for texts in batches:
            yield texts.map(one)

    return _rows(documents, cut("text"), "tokens")


def sentences(text: Column | str) -> Column:
    """Split at white space after a full stop, exclamation or question mark."""
    return F.filter(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def split_semantic(documents: DataFrame, embed, threshold: float = 0.5, max_size: int = 2048, min_size: int = 100) -> DataFrame:
    """Sentences, cut where neighbours' cosine is below the threshold; pieces above max_size are cut to that length;
    a piece below min_size takes in the next one while both fit. embed: text column to vector column."""
    rows = documents.where(F.length(strip("text")) > 0).select("id", F.posexplode(sentences("text")).alias("pos", "sentence")).withColumn("v", embed(F.col("sentence")))
    order = Window.partitionBy("id").orderBy("pos")
    before = F.lag("v").over(order)
    rows = rows.withColumn("cut", F.when(before.isNotNull() & (cosine(before, F.col("v")) < threshold), 1).otherwise(0)).withColumn("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s")).select("id", "part", F.array_join(F.col("s.sentence"), " ").alias("piece"))
    pieces = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p")).select("id", F.col("p.piece").alias("pieces"))
    steps = lambda p: F.sequence(F.lit(0), F.ceil(F.length(p) / F.lit(float(max_size))).cast("int") - 1)
    capped = F.filter(F.flatten(F.transform("pieces", lambda p: F.transform(steps(p), lambda i: strip(F.substring(p, i * max_size + 1, F.lit(max_size)))))), lambda p: p != "")
    last = lambda acc: F.element_at(acc, -1)
    fits = lambda acc, p: (F.size(acc) > 0) & (F.length(last(acc)) < min_size) & (F.length(last(acc)) + 1 + F.length(p) <= max_size)
    merged = F.aggregate(capped, F.array().cast("array<string>"), lambda acc, p: F.when(fits(acc, p), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), p)))).otherwise(F.concat(acc, F.array(p))))
    done = pieces.select(F.col("id").alias("_id"), merged.alias("_merged"))
    joined = documents.join(done, F.col("id") == F.col("_id")).drop("_id")
    return _rows(joined, F.col("_merged"), "semantic")
