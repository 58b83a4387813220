"""Keyword search: postings, BM25 (Okapi, k1 1.5, b 0.75, negative idf lifted to 0.25 of the mean), and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.columns import let, words
from quillon.session import settle

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """term, key, tf, length: one row per distinct word of a text. Worth storing sorted by term where many queries follow."""
    tokens = rows.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    return tokens.select(key, F.size("_w").alias("length"), F.explode("_w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def statistics(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row: documents, avg_length, terms, mean_idf (over the vocabulary, before negative values are lifted)."""
    sizes = rows.select(F.size(words(F.coalesce(F.col(text), F.lit("")))).alias("length")).agg(F.count("*").alias("documents"), F.avg("length").alias("avg_length"))
    return _with_vocabulary(sizes, rows, text)


def _with_vocabulary(sizes: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Adds terms and mean_idf to the one row of sizes."""
    own = F.explode(F.array_distinct(words(F.coalesce(F.col(text), F.lit("")))))
    df = rows.select(own.alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    counts = df.groupBy("df").agg(F.count("*").alias("terms"))  # few rows: one per document frequency
    both = counts.join(F.broadcast(sizes), how="left")
    idf = F.log(F.col("documents") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    vocabulary = both.agg(F.sum("terms").alias("terms"), (F.sum(idf * F.col("terms")) / F.sum("terms")).alias("mean_idf"))
    return sizes.join(F.broadcast(vocabulary), how="left")


def bm25(rows: DataFrame, query: str, key: str = "id", text: str = "text") -> DataFrame:
    """key, score of every row (0 without a hit); repeated query words count repeatedly. Statistics are those of `rows`,
    so a filter applied before it counts. Only the query's words leave the scan: each row is reduced to its counts of
    them before anything is shuffled. Null texts are empty."""
    wanted = query.lower().split()
    terms = sorted(set(wanted))
    counts = lambda w: F.struct(F.size(w).alias("length"), F.array(*[F.size(w) - F.size(F.array_remove(w, F.lit(t))) for t in terms]).cast("array<int>").alias("tf"))
    # one pass over the texts leaves a length and a few counts of each row
    counted = settle(rows.select(key, let(words(F.coalesce(F.col(text), F.lit(""))), counts).alias("c")).select(key, "c.length", "c.tf"))
    if not terms:
        return counted.select(key, F.lit(0.0).alias("score"))
    hits = F.array(*[F.count(F.when(F.col("tf")[i] > 0, 1)) for i in range(len(terms))])
    sizes = counted.agg(F.count("*").alias("documents"), F.avg("length").alias("avg_length"), hits.alias("dfs"))
    one = _with_vocabulary(sizes, rows, text)  # a single row
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        df, tf = F.col("dfs")[i], F.col("tf")[i]
        idf = F.log(F.col("documents") - df + 0.5) - F.log(df + 0.5)
        idf = F.when(df == 0, 0.0).when(idf < 0, EPSILON * F.col("mean_idf")).otherwise(idf)
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
        score = score + wanted.count(term) * F.when(tf > 0, idf * gain).otherwise(0.0)
    return counted.join(F.broadcast(one), how="left").select(key, F.round(score, 12).alias("score"))


class KeywordIndex:
    """Postings, lengths and statistics of one set of rows, kept as Parquet, so that a query reads the postings of its
    own terms only. Postings lie in folders by a hash of the term, sorted by term within."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/statistics/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.BUCKETS)).cast("int")

    def build(self, rows: DataFrame, key: str = "id", text: str = "text") -> None:
        """The statistics are written last and mark the index as complete. A term's postings are spread over several tasks."""
        own = postings(rows, key, text).select("term", F.col(key).alias("key"), "tf", "length").withColumn("bucket", self._bucket(F.col("term")))
        spread = own.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("bucket", "term")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        statistics(rows, key, text).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/statistics")

    def scores(self, query: str) -> DataFrame:
        """key, score (that of bm25) of the rows with a hit; all others have 0."""
        wanted = query.lower().split()
        weights = [(t, float(wanted.count(t))) for t in sorted(set(wanted))]
        terms = self.spark.createDataFrame(weights, "term string, weight double")
        if not weights:
            return terms.select(F.col("term").alias("key"), F.col("weight").alias("score"))
        buckets = reduce(Column.__or__, [F.col("bucket") == self._bucket(F.lit(t)) for t, _ in weights])
        hits = self.spark.read.parquet(f"{self.path}/postings").where(buckets & F.col("term").isin([t for t, _ in weights]))
        one = self.spark.read.parquet(f"{self.path}/statistics")  # a single row
        df = hits.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term").join(F.broadcast(one), how="left")
        raw = F.log(F.col("documents") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        df = df.select("term", (F.col("weight") * F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw)).alias("idf"), "avg_length")
        gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
        return hits.join(F.broadcast(df), "term").groupBy("key").agg(F.round(F.sum(gain), 12).alias("score"))


def ranks(scored: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Adds rank 0.. in the given order. With `most`, only so many best rows are kept, by a bounded top-k; without,
    every row gets its rank from a range-partitioned sort, in two passes, so that no task sees all rows."""
    if most is not None:
        top = scored.orderBy(*order).limit(most)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    placed = settle(scored.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_before")


def fuse(left: DataFrame, right: DataFrame, alpha: float = 0.5, k: int = 60, offset: int = 1, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of two rankings (key, rank from 0): alpha / (k + rank + offset) of the left one plus
    (1 - alpha) / (k + rank + offset) of the right one, a missing one counting 0. Gives key, score, distance = 1 - score."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    a = left.select(key, F.col("rank").alias("_l"))
    b = right.select(key, F.col("rank").alias("_r"))
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (F.lit(float(k + offset)) + F.col(rank)), F.lit(0.0))
    score = F.round(part(alpha, "_l") + part(1 - alpha, "_r"), 9)
    return a.join(b, key, "full").select(key, score.alias("score"), F.round(1 - score, 9).alias("distance"))


def vector_fetch(count: int, k: int, alpha: float) -> int:
    """How many vector hits a hybrid query fuses."""
    return 0 if alpha == 0 else min(count, max(k, int(4 * k * alpha)))
