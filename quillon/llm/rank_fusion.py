"""One ranking from several differently-scaled scores: outranking net flow (the PROMETHEE II method).

Each score is turned into a percentile within the rows it is comparable with, so neither its scale nor its spread
matters. For two rows the preference of one over the other by a score is 0 up to a difference `indifference` of their
percentiles, 1 from `strict` on, and linear between. A row's flow by a score is its summed preferences over all other
rows of the query minus theirs over it, divided by their number; the net flow is the weighted sum of the flows.
The sums over all rows are exact and need no pair of rows: on rows sorted by percentile they follow from counts and
sums of the percentiles up to x - strict, x - indifference, x + indifference and x + strict, i.e. from prefix sums.

Groups of up to `group_rows` rows use window frames. Larger ones (a query may hold a third of all rows) are cut into
ranges of the score, with prefix sums within and across ranges, so no group is ever gathered into one task.

Defined results: rows with null or NaN in a score take no part, repeated rows (equal but for their number and times)
count once, ties share place and percentile (the middle of their ranks), infinite values are ordinary extreme values,
a row alone in its query has net flow 0. Null query_id or collection or id are values like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import settle, wide

GROUP_ROWS = 100_000
INDIFFERENCE, STRICT = 0.05, 0.5
#: name, sign that makes smaller better, columns within which the score is comparable besides query_id
SCORES = (("distance", 1, ("query_id", "collection")), ("rerank_score", -1, ("query_id",)))
_KEYS = ["query_id", "collection", "id", "distance", "rerank_score"]
_AT = {"below_strict": -1, "below": -1, "above": 1, "above_strict": 1}


def _flow(x: str, n: Column, c: dict[str, Column], s: dict[str, Column], q: float, p: float) -> Column:
    """Net flow of one score from counts c and sums s of the percentiles up to the four thresholds; a small x is good."""
    at = F.col(x)
    # rows better than this one by more than q are those with percentiles below x - q
    lost = c["below_strict"] + ((c["below"] - c["below_strict"]) * (at - q) - (s["below"] - s["below_strict"])) / (p - q)
    far = n - c["above_strict"]
    won = far + ((s["above_strict"] - s["above"]) - (c["above_strict"] - c["above"]) * (at + q)) / (p - q)
    return F.when(n > 1, (won - lost) / (n - 1)).otherwise(F.lit(0.0))


def _shift(q: float, p: float) -> dict[str, float]:
    return {"below_strict": -p, "below": -q, "above": q, "above_strict": p}


def _by_windows(rows: DataFrame, q: float, p: float, weights: list[float]) -> DataFrame:
    for name, sign, keys in SCORES:
        order = F.col(name).asc() if sign > 0 else F.col(name).desc()
        w = Window.partitionBy(*keys).orderBy(order)
        rows = rows.withColumn(f"place_{name}", F.rank().over(w)).withColumn("_peers", F.count("*").over(w.rangeBetween(0, 0))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        rows = rows.withColumn(f"x_{name}", (F.col(f"place_{name}") - 1 + F.col("_peers") / 2) / F.col("_n")).drop("_peers", "_n")
    net = []
    for (name, _, _), weight in zip(SCORES, weights):
        x = f"x_{name}"
        c, s = {}, {}
        for tag, d in _shift(q, p).items():
            frame = f"over (partition by query_id order by {x} range between unbounded preceding and {abs(d)!r}D {'preceding' if d < 0 else 'following'})"
            rows = rows.withColumn(f"_c_{tag}", F.expr(f"count(*) {frame}")).withColumn(f"_s_{tag}", F.expr(f"coalesce(sum({x}) {frame}, 0D)"))
            c[tag], s[tag] = F.col(f"_c_{tag}"), F.col(f"_s_{tag}")
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
        rows = rows.withColumn(f"flow_{name}", _flow(x, F.col("_n"), c, s, q, p)).drop("_n", *[f"_{k}_{t}" for k in "cs" for t in _AT])
        net.append(F.col(f"flow_{name}") * weight)
    rows = rows.withColumn("net_flow", F.round(reduce(Column.__add__, net), 9) + F.lit(0.0))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("net_flow"))))


def _cumulative(values: DataFrame, keys: list[str], probes: DataFrame, ranges: int) -> DataFrame:
    """values: keys, x, cnt (each x of a group once). probes: keys, t, and other columns. Adds to each probe the number
    c and the sum s of the values up to t, and the group's n. Groups are cut into `ranges` ranges at quantiles."""
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])
    grid = [i / ranges for i in range(1, ranges)]
    splits = values.groupBy(*keys).agg(F.percentile_approx("x", grid, max(10_000, 10 * ranges)).alias("grid"), F.sum("cnt").alias("n"))
    splits = settle(splits.withColumn("grid", F.array_distinct("grid")))
    extra = [c for c in probes.columns if c not in (*keys, "t")]
    zero = {c: F.lit(None).cast(probes.schema[c].dataType) for c in extra}
    v = values.select(*keys, F.col("x").alias("t"), F.col("cnt").cast("double").alias("cnt"), (F.col("cnt") * F.col("x")).alias("sx"), F.lit(0).alias("probe"), *[zero[c].alias(c) for c in extra])
    u = probes.select(*keys, "t", F.lit(0.0).alias("cnt"), F.lit(0.0).alias("sx"), F.lit(1).alias("probe"), *extra)
    both = v.unionByName(u)
    joined = both.join(splits, same(both, splits), "left").drop(*[splits[k] for k in keys])
    joined = joined.withColumn("bucket", F.size(F.filter("grid", lambda g: g < F.col("t")))).drop("grid")
    joined = settle(joined)
    inside = Window.partitionBy(*keys, "bucket").orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = joined.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("bc"), F.sum("sx").alias("bs"))
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("bc").over(before), F.lit(0.0)).alias("bc"), F.coalesce(F.sum("bs").over(before), F.lit(0.0)).alias("bs"))
    run = joined.withColumn("c", F.sum("cnt").over(inside)).withColumn("s", F.sum("sx").over(inside)).where("probe = 1")
    out = run.join(sums, same(run, sums) & (run["bucket"] == sums["bucket"])).select(*[run[k] for k in keys], "t", *extra, (F.col("c") + F.col("bc")).alias("c"), (F.col("s") + F.col("bs")).alias("s"), "n")
    return settle(out)


def _eq(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def _by_ranges(rows: DataFrame, q: float, p: float, weights: list[float], ranges: int) -> DataFrame:
    for name, sign, keys in SCORES:
        keys = list(keys)
        rows = settle(rows.withColumn("_v", F.col(name) * sign))
        values = settle(rows.groupBy(*keys, F.col("_v").alias("x")).agg(F.count("*").alias("cnt")))
        # sums of the raw score aren't used here; infinite ones would spoil nothing else
        ranks = _cumulative(values, keys, values.select(*keys, F.col("x").alias("t"), F.col("cnt").alias("own")), ranges)
        ranks = ranks.select(*keys, F.col("t").alias("_v"), (F.col("c") - F.col("own") + 1).cast("int").alias(f"place_{name}"), ((F.col("c") - F.col("own") / 2) / F.col("n")).alias(f"x_{name}"))
        rows = rows.join(ranks, _eq(rows, ranks, [*keys, "_v"])).drop(*[ranks[k] for k in [*keys, "_v"]]).drop("_v")
    net = []
    for (name, _, _), weight in zip(SCORES, weights):
        x = f"x_{name}"
        rows = settle(rows)
        values = settle(rows.groupBy("query_id", F.col(x).alias("x")).agg(F.count("*").alias("cnt")))
        tags = F.array(*[F.struct(F.lit(t).alias("tag"), (F.col("x") + F.lit(d)).alias("t")) for t, d in _shift(q, p).items()])
        probes = values.select("query_id", F.col("x").alias("of"), F.explode(tags).alias("e")).select("query_id", "of", "e.tag", "e.t")
        found = _cumulative(values, ["query_id"], probes, ranges)
        c = {t: F.max(F.when(F.col("tag") == t, F.col("c"))).alias(f"_c_{t}") for t in _AT}
        s = {t: F.max(F.when(F.col("tag") == t, F.col("s"))).alias(f"_s_{t}") for t in _AT}
        flat = found.groupBy("query_id", "of", "n").agg(*c.values(), *s.values())
        flat = flat.select("query_id", F.col("of").alias(x), _flow("of", F.col("n"), {t: F.col(f"_c_{t}") for t in _AT}, {t: F.col(f"_s_{t}") for t in _AT}, q, p).alias(f"flow_{name}"))
        rows = rows.join(flat, _eq(rows, flat, ["query_id", x])).drop(flat["query_id"]).drop(flat[x])
        net.append(F.col(f"flow_{name}") * weight)
    rows = settle(rows.withColumn("net_flow", F.round(reduce(Column.__add__, net), 9) + F.lit(0.0)))
    values = settle(rows.groupBy("query_id", (-F.col("net_flow")).alias("x")).agg(F.count("*").alias("cnt")))
    place = _cumulative(values, ["query_id"], values.select("query_id", F.col("x").alias("t"), F.col("cnt").alias("own")), ranges)
    place = place.select("query_id", (-F.col("t")).alias("net_flow"), (F.col("c") - F.col("own") + 1).cast("int").alias("rank"))
    return rows.join(place, _eq(rows, place, ["query_id", "net_flow"])).drop(place["query_id"]).drop(place["net_flow"])


def outranking(results: DataFrame, weights: tuple[float, float] = (0.5, 0.5), indifference: float = INDIFFERENCE, strict: float = STRICT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, collection, id, distance, rerank_score, place_distance, place_rerank_score (1 + number of better rows),
    flow_distance, flow_rerank_score, net_flow and rank (1 + number of rows of the query with a larger net flow)."""
    spark = results.sparkSession
    rows = results.select(*_KEYS).where("distance is not null and rerank_score is not null and not isnan(distance) and not isnan(rerank_score)")
    counts = rows.groupBy("query_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") > group_rows)
    big = settle(counts)  # at most rows / group_rows queries
    out = [*_KEYS, "place_distance", "place_rerank_score", "flow_distance", "flow_rerank_score", "net_flow", "rank"]
    if big.isEmpty():
        return _by_windows(rows.repartition(wide(spark), "query_id").distinct(), indifference, strict, list(weights)).select(out)
    mark = F.broadcast(big.select(F.col("query_id").alias("_big")))
    small = rows.join(mark, F.col("query_id").eqNullSafe(F.col("_big")), "left_anti")
    hot = rows.join(mark, F.col("query_id").eqNullSafe(F.col("_big")), "left_semi").distinct()
    ranges = max(2, -(-big.agg(F.max("_rows")).first()[0] // group_rows))
    a = _by_windows(small.repartition(wide(spark), "query_id").distinct(), indifference, strict, list(weights)).select(out)
    return a.unionByName(_by_ranges(hot, indifference, strict, list(weights), ranges).select(out))
