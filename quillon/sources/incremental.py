"""Which files changed since the last run, and what that means for a collection."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = "path string, sha256 string"


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, sha256 of all files under path whose names match, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


def difference(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, sha256 (current), state: new, changed, unchanged or deleted. Both sides: path (unique), sha256."""
    now, old = current.select("path", F.col("sha256").alias("_now")), stored.select("path", F.col("sha256").alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") == F.col("_old"), "unchanged").otherwise("changed")
    return now.join(old, "path", "full").select("path", F.col("_now").alias("sha256"), state.alias("state"))


def updated(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored fingerprints after the changes (path, sha256, state)."""
    kept = stored.join(changes.where("state <> 'unchanged'").select("path"), "path", "left_anti").select("path", "sha256")
    return kept.unionByName(changes.where("state in ('new', 'changed')").select("path", "sha256"))


class FingerprintStore:
    """Fingerprints kept as Parquet; unreadable ones count as none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, os.path.join(folder, "_fingerprints")

    def load(self) -> DataFrame:
        try:
            return self._read()
        except Exception:  # noqa: BLE001
            return self.spark.createDataFrame([], EMPTY)

    def _read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path).select("path", "sha256")
        rows.limit(1).collect()
        return rows

    def save(self, rows: DataFrame) -> None:
        from quillon.session import settle

        settle(rows.select("path", "sha256")).write.mode("overwrite").parquet(self.path)


def sync_directory(spark: SparkSession, path: str, collection, embed, split=None, glob: str = "**/*.txt") -> dict[str, int]:
    """Load what is new or changed, split, embed, and replace the rows of changed and deleted files. Returns counts by state."""
    from quillon.session import settle
    from quillon.sources.loaders import load_directory

    store = FingerprintStore(spark, collection.path + ".state")
    changes = settle(difference(fingerprints(spark, path, glob.rsplit("/", 1)[-1]), store.load()))
    counts = {r["state"]: r["n"] for r in changes.groupBy("state").agg(F.count("*").alias("n")).collect()}
    gone = changes.where("state = 'deleted' or state = 'changed'").select(F.col("path").alias("_source"))
    fresh = load_directory(spark, path, glob)
    fresh = fresh.join(changes.where("state in ('new', 'changed')").select(F.col("path").alias("_source")), F.element_at("metadata", "source") == F.col("_source"), "left_semi")
    fresh = fresh.where(F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0)
    rows = embed(split(fresh) if split else fresh)
    kept = collection.rows().join(gone, F.element_at("metadata", "source") == F.col("_source"), "left_anti")
    from quillon.operators.collection import upserted

    collection._write(upserted(kept, collection.conformed(rows)))
    store.save(updated(store.load(), changes))
    return counts
