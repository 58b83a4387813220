"""Entities that appear together: basket collapsing.

The basket of a document is the sorted array of its distinct entities. Identical baskets are grouped into one with a
weight; pairs are enumerated once per distinct basket and their weights summed. Entities in fewer than `least`
documents can't be part of a pair of `least` documents and are left out of the baskets, which loses no such pair.
A basket of more than `part` entities is cut into parts, each pair of parts gets a key of its own, and pairs are formed
part by part, so no row or task ever holds more than part * part pairs of one basket. Documents of more than `giant`
entities are never gathered: their entities go to parts by a hash at once, and count with weight one.

Defined results: names are compared in lower case; null names and null documents are left out; a document counts once
however often it is listed; an entity forms no pair with itself; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import join_hot, join_small, settle

PART, GIANT = 200, 20_000


def mentions(entities: DataFrame) -> DataFrame:
    """name (lower case), doc: each once."""
    return entities.where("name is not null").select(F.lower("name").alias("name"), F.explode(F.array_distinct("doc_ids")).alias("doc")).where("doc is not null").distinct()


def cooccurring_pairs(entities: DataFrame, least: int = 1, part: int = PART, giant: int = GIANT) -> DataFrame:
    """source < target, n_ab, n_a, n_b, n_docs, lift, and conviction of source -> target (null: never without)."""
    rows = settle(mentions(entities))
    docs = settle(rows.groupBy("doc").agg(F.lit(1).alias("one"))).count()
    names = rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # numbers follow the names' order, so that a < b by number is a < b by name
    names = settle(names.orderBy("name").withColumn("code", F.monotonically_increasing_id()))
    coded = settle(join_hot(rows, names, "name", "n", F.col("doc")).select("doc", "code"))
    giants = settle(coded.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > giant))  # at most rows / giant
    usual = coded.join(F.broadcast(giants.select("doc")), "doc", "left_anti")
    baskets = usual.groupBy("doc").agg(F.sort_array(F.collect_list("code")).alias("items"))
    weighted = settle(baskets.where(F.size("items") > 1).groupBy("items").agg(F.count("*").alias("weight")).withColumn("basket", F.monotonically_increasing_id().cast("string")))
    own = weighted.where(F.size("items") <= part).select("weight", F.posexplode("items").alias("at", "a"), "items")
    pairs = own.select("weight", "a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))

    n_parts = F.ceil(F.size("items") / part).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: F.slice("items", i * part + 1, part))
    parts = weighted.where(F.size("items") > part).select("basket", "weight", n_parts.alias("n"), F.posexplode(cut).alias("i", "items"))
    spread = coded.join(F.broadcast(giants), "doc").select(F.concat(F.lit("/"), "doc").alias("basket"), F.ceil(F.col("n") / part).cast("int").alias("n"), "code")
    spread = spread.groupBy("basket", "n", F.pmod(F.xxhash64("code"), F.col("n")).cast("int").alias("i")).agg(F.collect_list("code").alias("items"))
    parts = settle(parts.unionByName(spread.withColumn("weight", F.lit(1).cast("long"))))
    left = parts.select("basket", "weight", "i", F.col("items").alias("left"), F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j"))
    right = parts.select("basket", F.col("i").alias("j"), F.col("items").alias("right"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"))
    both = left.join(right, ["basket", "i", "j"]).select("weight", (F.col("i") == F.col("j")).alias("same"), F.explode("left").alias("x"), "right")
    both = both.select("weight", "same", "x", F.explode("right").alias("y")).where("not same or x < y")
    pairs = pairs.unionByName(both.select("weight", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    counts = settle(pairs.groupBy("a", "b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= least))
    counts = join_small(counts, names.select(F.col("code").alias("a"), F.col("name").alias("source"), F.col("n").alias("n_a")), "a")
    counts = join_small(counts, names.select(F.col("code").alias("b"), F.col("name").alias("target"), F.col("n").alias("n_b")), "b")
    n = F.lit(docs).cast("long")
    rest = 1 - F.col("n_ab") / F.col("n_a")
    return counts.select(
        "source", "target", "n_ab", "n_a", "n_b", n.alias("n_docs"),
        (F.col("n_ab") * n / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
        F.when(rest > 0, (1 - F.col("n_b") / n) / rest).alias("conviction"),
    )
