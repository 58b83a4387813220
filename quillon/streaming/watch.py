"""Changes of files as a stream, folded per path and applied to a collection.

Spark's own file source sees new files only, so a streaming data source compares listings: its offset holds the paths
with their sizes and times, and a batch holds what differs between two offsets.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, op string, seq long"


def fold_changes(changes: DataFrame) -> DataFrame:
    """path, op: the last operation (by seq) of each path decides."""
    return changes.groupBy("path").agg(F.max_by("op", "seq").alias("op"))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = tuple(e for e in options.get("extensions", "").split(",") if e)

    def _listing(self) -> dict[str, list[int]]:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if not self.extensions or name.endswith(self.extensions):
                    path = os.path.join(folder, name)
                    try:
                        s = os.stat(path)
                    except OSError:
                        continue
                    out[path] = [s.st_mtime_ns, s.st_size]
        return out

    def initialOffset(self) -> dict:
        return {"files": "{}", "seq": "0"}

    def _between(self, old: dict, new: dict, seq: int) -> list[tuple]:
        changed = [(p, "upsert", seq) for p, s in sorted(new.items()) if old.get(p) != s]
        return changed + [(p, "delete", seq) for p in sorted(old) if p not in new]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new, seq = json.loads(start["files"]), self._listing(), int(start["seq"]) + 1
        rows = self._between(old, new, seq)
        return iter(rows), {"files": json.dumps(new, sort_keys=True), "seq": str(seq if rows else seq - 1)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(json.loads(start["files"]), json.loads(end["files"]), int(end["seq"])))


class FileChanges(DataSource):
    """Format `file_changes`; options path and extensions (joined by commas)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):
        return _Reader(self.options)


def change_stream(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", os.path.abspath(path)).option("extensions", ",".join(extensions or [])).load()


def apply_changes(spark: SparkSession, collection, changes: DataFrame, embed: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Deleted paths lose their rows; changed ones have theirs replaced, in one new snapshot."""
    from quillon.functions.columns import content_id
    from quillon.operators.collection import upserted
    from quillon.session import settle

    last = settle(fold_changes(changes))
    kept = collection.rows().join(last.select(F.col("path").alias("_source")), F.element_at("metadata", "source") == F.col("_source"), "left_anti")
    paths = last.where("op <> 'delete'")

    def read(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with open(p, encoding="utf-8") as f:
                        rows.append((f.read(), {"source": p, "filename": os.path.basename(p)}))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["text", "metadata"])

    texts = paths.select("path").mapInPandas(read, "text string, metadata map<string,string>").where(F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0)
    docs = texts.select(content_id("text").alias("id"), "text", "metadata")
    collection._write(upserted(kept, collection.conformed(embed(split(docs) if split else docs))))


def watch(spark: SparkSession, path: str, collection, embed, split=None, extensions: list[str] | None = None, every: str = "500 milliseconds", checkpoint: str | None = None, once: bool = False):
    """Starts the stream; returns the streaming query."""
    writer = change_stream(spark, path, extensions).writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else apply_changes(spark, collection, batch, embed, split))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if not once else writer.trigger(once=True).start()
