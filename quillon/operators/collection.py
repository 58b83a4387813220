"""Collections: named tables of (id, text, metadata, embedding, source_id, chunk_index) kept as Parquet snapshots.

A write makes a new snapshot folder with the next number. The snapshot that holds is the complete one (with Spark's
_SUCCESS mark, which is written last) of the highest number, so readers see the old or the new state and nothing in
between, and a writer that dies leaves the old one. The snapshot before it stays for the queries that still read it.
One writer at a time. Rows are spread by a hash of the id; how many files that makes follows their size (AQE).
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.columns import condition
from quillon.operators.search import top_k

SCHEMA = "id string, text string, metadata map<string,string>, embedding array<float>, source_id string, chunk_index int"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Complete snapshots in the order they were written."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [n for n in names if n.startswith("v-") and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]


class Collection:
    def __init__(self, spark: SparkSession, folder: str, name: str, metric: str = "l2sq"):
        self.spark, self.name, self.metric = spark, name, metric
        self.path = f"{folder.rstrip('/')}/{name}"

    def snapshot(self) -> str | None:
        found = _snapshots(self.spark, self.path)
        return found[-1] if found else None

    def rows(self) -> DataFrame:
        name = self.snapshot()
        if name is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame) -> None:
        found = _snapshots(self.spark, self.path)
        number = int(found[-1].split("-")[1]) + 1 if found else 1
        new = f"v-{number:012d}-{uuid.uuid4().hex}"
        rows.select([F.col(f.split()[0]) for f in SCHEMA.split(", ")]).repartition("id").sortWithinPartitions("id").write.parquet(f"{self.path}/{new}")
        fs, _ = _folder(self.spark, self.path)
        for old in found[:-1]:
            fs.delete(_folder(self.spark, f"{self.path}/{old}")[1], True)

    @staticmethod
    def conformed(rows: DataFrame, arrival: str | None = None) -> DataFrame:
        """The collection's columns of any rows with id, text and embedding; of repeated ids the last to arrive stays.
        Rows arrive in the order of the column `arrival`, else in that of the frame (of the list or the files it is from)."""
        have = dict(rows.dtypes)
        cols = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in SCHEMA.split(", "))]
        number = F.col(arrival) if arrival else F.monotonically_increasing_id()
        last = Window.partitionBy("id").orderBy(F.desc_nulls_last("_arrival"))
        return rows.select(*cols, number.alias("_arrival")).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_arrival")

    def upsert(self, rows: DataFrame, arrival: str | None = None) -> None:
        """Blank texts are refused before anything is written."""
        new = self.conformed(rows, arrival).persist()
        try:
            if not new.where(F.col("text").isNull() | (F.length(F.regexp_replace("text", r"(?U)\s+", "")) == 0)).isEmpty():
                raise ValueError("a document has no text")
            self._write(upserted(self.rows(), new))
        finally:
            new.unpersist()

    def replace_sources(self, rows: DataFrame) -> None:
        """Upsert after deleting all rows of the sources that the new rows come from, so no old chunk stays behind."""
        sources = rows.select(F.element_at("metadata", "source").alias("_source")).where("_source is not null").distinct()
        kept = self.rows().join(sources, F.element_at("metadata", "source") == F.col("_source"), "left_anti")
        self._write(upserted(kept, self.conformed(rows)))

    def search(self, query: list[float], k: int = 5, where: dict[str, Any] | None = None) -> DataFrame:
        own = {"source_id": F.col("source_id"), "chunk_index": F.col("chunk_index")}
        return top_k(self.rows(), query, k, condition(where, F.col("metadata"), own) if where else None, self.metric).select("id", "text", "metadata", "source_id", "chunk_index", "distance")

    def delete(self, ids: list[str] | DataFrame) -> None:
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        self._write(self.rows().join(gone.select("id"), "id", "left_anti"))

    def delete_sources(self, sources: list[str]) -> None:
        self._write(self.rows().where(~F.coalesce(F.element_at("metadata", "source").isin(sources), F.lit(False))))

    def count(self) -> int:
        return self.rows().count()

    def all(self) -> DataFrame:
        return self.rows().select("id", "text", "metadata")

    def by_ids(self, ids: list[str]) -> DataFrame:
        """In the order of the request; unknown ids are left out."""
        asked = self.spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "id string, _n int")
        return self.rows().join(asked, "id").orderBy("_n").select("id", "text", "metadata")

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `existing` whose id isn't in `new`, and `new`."""
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new)


def collection_names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _folder(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(name for s in fs.listStatus(p) if s.isDirectory() and _snapshots(spark, f"{folder}/{(name := s.getPath().getName())}"))
