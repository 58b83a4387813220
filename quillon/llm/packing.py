"""Filling fixed-capacity containers: first-fit decreasing on a tournament tree, in randomised groups of documents.

A document above the capacity, and only such a one, is split: its full pieces are containers of their own, its rest is
packed like a document. All rests and smaller documents go by a hash of their doc_id to groups of about `group` items,
and each group is packed by first-fit decreasing; the tree over the bins' free space finds the first bin that fits in
logarithmic time. A group leaves at most a few bins part empty, so little is lost against one packing of everything.

Defined results: null texts are left out; an empty text takes no space but has a container; ties in size go by
doc_id; capacities that are null or below 1 are ignored; repeated documents are repeated items.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import VOCABULARY, sized
from quillon.session import settle, wide

GROUP = 20_000
LITERALS = 500


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; sizes are in falling order and at most the capacity."""
    leaves = 1
    while leaves < max(len(sizes), 1):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = []
    for s in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if free[at] < s:
                at += 1
        out.append(at - leaves)
        free[at] -= s
        at //= 2
        while at:
            most = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == most:
                break
            free[at] = most
            at //= 2
    return out


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    bins = first_fit_decreasing(table.column("tokens").to_pylist(), table.column("capacity")[0].as_py())
    name = f"g{key[1].as_py()}-"
    return pa.table({"budget_id": table.column("budget_id"), "container_id": pa.array([f"{name}{b}" for b in bins], pa.string()), "doc_id": table.column("doc_id"), "piece": table.column("piece"), "token_start": table.column("token_start"), "tokens": table.column("tokens")})


def containers(documents: DataFrame, budgets: DataFrame, group: int = GROUP, seed: int = 11, vocabulary: str = VOCABULARY) -> DataFrame:
    """budget_id, container_id, doc_id, piece, token_start, tokens: every document in a container of every budget."""
    spark = documents.sparkSession
    caps = budgets.where("capacity_tokens >= 1").select("budget_id", "capacity_tokens").distinct().collect()  # settings, a row per budget
    schema = "budget_id int, container_id string, doc_id long, piece int, token_start long, tokens long"
    if not caps:
        return spark.createDataFrame([], schema)
    sizes = settle(sized(documents, vocabulary).select("doc_id", "tokens"))
    groups = max(1, -(-sizes.count() // group))
    # literals of bounded length; every document is due in every budget
    arrays = [F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in caps[i : i + LITERALS]]) for i in range(0, len(caps), LITERALS)]
    items = reduce(DataFrame.unionByName, [sizes.select("doc_id", "tokens", F.explode(a).alias("b")) for a in arrays]).select("doc_id", "tokens", "b.budget_id", "b.capacity")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    items = items.withColumn("full", F.when(F.col("tokens") > F.col("capacity"), full).otherwise(0))
    whole = items.where("full > 0").select("budget_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select("budget_id", F.concat(F.lit("d"), "doc_id", F.lit("-"), "piece").alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"))
    start = F.col("full") * F.col("capacity")
    rest = items.where((F.col("tokens") > start) | (F.col("full") == 0))
    rest = rest.select("budget_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).alias("grp"), "doc_id", F.col("full").alias("piece"), start.alias("token_start"), (F.col("tokens") - start).alias("tokens"), "capacity")
    packed = rest.repartition(wide(spark, min(groups * len(caps), 100_000)), "budget_id", "grp").groupBy("budget_id", "grp").applyInArrow(_pack, schema)
    return packed.unionByName(whole)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, containers, tokens, filled: the share of all space that is used."""
    per = packed.groupBy("budget_id", "container_id").agg(F.sum("tokens").alias("t")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    caps = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity_tokens").cast("long").alias("c")).distinct()
    return per.join(caps, "budget_id").select("budget_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("c"))).alias("filled"))
