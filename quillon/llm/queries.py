"""Queries of the subpackage by name: each takes the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chunking, cooccurrence, format_dedup, markup, mixing, mojibake, neardup, packing, rank_fusion, vptree
from quillon.session import read_table, settle


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking is computed in full and written, so the places come out of the same rows as the net flows."""
    ranked = settle(rank_fusion.outranking(read_table(spark, sf_dir, "query_results")))
    return ranked.where("place_distance <= 3 and place_rerank_score <= 3").select("query_id", "id").distinct()


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_fusion.outranking(read_table(spark, sf_dir, "query_results"))
    return ranked.select("query_id", "collection", "id", "place_distance", "place_rerank_score", F.round("net_flow", 6).alias("net_flow"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dedup.further_copies(read_table(spark, sf_dir, "documents"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dedup.records(read_table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document has a second piece if and only if its text is longer than the limit."""
    return _chunks(spark, sf_dir).where("chunk_index = 1").select("doc_id")


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "index_config"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.cooccurring_pairs(read_table(spark, sf_dir, "entities"), least=5)
    return pairs.where("n_ab * n_docs >= 5 * n_a * n_b").select("source", "target")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.cooccurring_pairs(read_table(spark, sf_dir, "entities"))
    return pairs.select("source", "target", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(read_table(spark, sf_dir, "documents"), threshold=0.6, shingle=3).select("doc_id_a", "doc_id_b")


def p5_near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose tree has a node beside its root."""
    return markup.clean_texts(read_table(spark, sf_dir, "documents")).where("nodes > 0").select("doc_id")


def p6_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(read_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.similar_vector_pairs(read_table(spark, sf_dir, "documents"), k=5, min_cosine=0.9).select("doc_id_a", "doc_id_b")


def p7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose doc_id is divisible by 100, against all documents."""
    near = vptree.nearest(read_table(spark, sf_dir, "documents"), k=5, factor=1.5, queries=F.expr("doc_id % 100 = 0"))
    return near.withColumn("cosine", F.round("cosine", 6))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "context_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir), read_table(spark, sf_dir, "context_budgets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), read_table(spark, sf_dir, "source_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found_documents(read_table(spark, sf_dir, "documents"))


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quillon.llm.oracles import SQL

    return dict(SQL)
