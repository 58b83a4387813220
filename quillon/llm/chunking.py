"""Splitting oversized texts: dynamic programming over boundary positions.

Each piece but the first begins `overlap` characters before the end of the one before it; no piece has more than
`size` characters; together they cover the whole text. Among all such cuts at candidate positions the one with the
smallest sum of cut penalties, size imbalance and a constant per piece is taken. Candidates are all ends of
paragraphs, lines and sentences; in stretches without them, of more than half a piece, all ends of clauses and words; and
in stretches without those, evenly spaced positions inside words, never before a combining mark or joiner.

Defined results: null and short texts come out whole (null: no piece, empty: none). A size below 1 or null means the
default; an overlap below 0 or null likewise, one that leaves no room is lowered to size - 1. Lengths are code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 512, 64
#: Penalty of a cut by what ends there.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "clause": 4.0, "word": 6.0, "inside": 20.0, "end": 0.0}
PIECE, BALANCE = 1.0, 20.0
_COARSE = re.compile(r"(?P<paragraph>\n[ \t\r]*\n\s*)|(?P<line>\n)|(?P<sentence>[.!?…。！？][\"'”’»)\]]*\s+)")
_FINE = re.compile(r"(?P<clause>[;:,–—]\s+)|(?P<word>\s+)")


def _joined(c: str) -> bool:
    return c in "‍️︎" or unicodedata.combining(c) != 0


def candidates(text: str, step: int) -> tuple[list[int], list[str]]:
    """Positions of possible cuts and what ends there; gaps are at most half a step, and at least one character."""
    n, half = len(text), max(1, step // 2)
    found = [(m.end(), m.lastgroup) for m in _COARSE.finditer(text) if m.end() < n]
    for finer in (_FINE, None):
        out, last = [], 0
        for pos, kind in [*found, (n, "end")]:
            if pos - last > half:
                if finer:
                    out += [(m.end(), m.lastgroup) for m in finer.finditer(text, last, pos) if last < m.end() < pos]
                else:
                    parts = -(-(pos - last) // max(1, half // 2))
                    before = last
                    for i in range(1, parts):
                        p = last + (pos - last) * i // parts
                        while p > before and (_joined(text[p]) or text[p - 1] == "‍"):
                            p -= 1
                        if p > before:
                            out.append((p, "inside"))
                            before = p
            if pos < n:
                out.append((pos, kind))
            last = pos
        found = out
    return [p for p, _ in found], [k for _, k in found]


def split(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, what ends there) of each piece."""
    n = len(text)
    if n <= size:
        return [(0, n, "end")] if n else []
    step = size - overlap
    pos, kind = candidates(text, step)
    pos, kind = [*pos, n], [*kind, "end"]
    found = _best(pos, kind, n, size, overlap)
    if found is None:  # joined characters longer than a piece: any position may be a cut
        have = dict(zip(pos, kind))
        pos = list(range(1, n + 1))
        found = _best(pos, [have.get(p, "inside") for p in pos], n, size, overlap)
    return found


def _best(pos: list[int], kind: list[str], n: int, size: int, overlap: int) -> list[tuple[int, int, str]] | None:
    step = size - overlap
    pieces = -(-(n - overlap) // step)
    aim = (n - overlap) / pieces + overlap
    scale = BALANCE / size**2
    m = len(pos)
    cost, back = [float("inf")] * m, [-1] * m
    low = 0
    for i in range(bisect_right(pos, overlap), m):
        p = pos[i]
        best, at = float("inf"), -1
        if p <= size:
            best = scale * (p - aim) ** 2
        while pos[low] < p - step:
            low += 1
        shift = p + overlap - aim
        for j in range(low, i):
            d = shift - pos[j]
            c = cost[j] + scale * d * d
            if c < best:
                best, at = c, j
        cost[i], back[i] = best + PIECE + PENALTY[kind[i]], at
    if cost[-1] == float("inf"):
        return None
    ends, i = [], m - 1
    while i >= 0:
        ends.append(i)
        i = back[i]
    out, start = [], 0
    for i in reversed(ends):
        out.append((start, pos[i], kind[i]))
        start = pos[i] - overlap
    return out


def settings(index_config: DataFrame) -> DataFrame:
    """collection, chunk_size, chunk_overlap: the row with the latest updated_at holds; nulls mean the defaults."""
    last = Window.partitionBy("collection").orderBy(F.desc_nulls_last("updated_at"), F.desc("config_id"))
    rows = index_config.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select("collection", *[F.when(F.col(c) >= least, F.col(c)).otherwise(default).cast("int").alias(c) for c, least, default in (("chunk_size", 1, SIZE), ("chunk_overlap", 0, OVERLAP))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "chunk_index", "start", "end", "cut", "text"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        chars = 0
        for doc, text, size, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            for i, (a, b, kind) in enumerate(split(text, size, min(overlap, size - 1))):
                for col, x in zip(cols, (doc, i, a, b, kind, text[a:b])):
                    col.append(x)
            chars += len(text)
            if chars > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=names)
                cols, chars = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=names)


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def chunks(documents: DataFrame, index_config: DataFrame) -> DataFrame:
    """doc_id, chunk_index (from 0), start, end (code points), cut (what ends there), text. The settings, a row per
    collection, are joined to the documents; Spark broadcasts them only below its own size threshold."""
    conf = settings(index_config)
    docs = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").alias("collection"))
    docs = docs.join(conf, "collection", "left").select("doc_id", "text", F.coalesce("chunk_size", F.lit(SIZE)).alias("size"), F.coalesce("chunk_overlap", F.lit(OVERLAP)).alias("overlap"))
    return docs.mapInArrow(_cut, "doc_id long, chunk_index int, start int, end int, cut string, text string")
