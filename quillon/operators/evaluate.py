"""Ranking quality: reciprocal rank, DCG, NDCG and recall per query, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(results: DataFrame, expected: DataFrame, standard_ndcg: bool = False, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """Per query: reciprocal_rank, dcg, ndcg, recall. results: query_key, key, rank from 1. expected: query_key, key. The ideal
    of NDCG orders the retrieved relevant rows first; with standard_ndcg all relevant ones up to the length of the list.
    Queries without expected rows score 0; queries without results too."""
    wanted = expected.select(query_key, key).distinct().withColumn("_hit", F.lit(1))
    marked = results.select(query_key, key, "rank").join(wanted, [query_key, key], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    gain = F.col("_hit") / F.log2(F.col("rank") + 1.0)
    per = marked.groupBy(query_key).agg(F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.sum("_hit").cast("int").alias("hits"), F.count("*").cast("int").alias("shown"))
    needs = wanted.groupBy(query_key).agg(F.count("*").cast("int").alias("wanted"))
    rows = per.join(needs, query_key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.least(zero("wanted"), zero("shown")) if standard_ndcg else zero("hits")
    ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)))
    return rows.select(
        query_key,
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce("dcg", F.lit(0.0)), 6).alias("dcg"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(F.try_divide(zero("hits"), F.col("wanted")), F.lit(0.0)), 6).alias("recall"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    """queries, mrr, ndcg, recall: means, 0 without queries."""
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return per_query.agg(F.count("*").alias("queries"), mean("reciprocal_rank", "mrr"), mean("ndcg", "ndcg"), mean("recall", "recall"))
