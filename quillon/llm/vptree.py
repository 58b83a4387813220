"""Nearest neighbours of every vector: vantage-point trees over shards and per shard, with relaxed triangle-inequality pruning.

A tree whose nodes hold many vantage points, fitted on a bounded sample, splits space into shards: each vector goes to the
nearest vantage point, down to one home shard. Shards that come out large are split again by nodes fitted on samples of
their own. A query descends to its home shard and to those places whose boundary plane with the nearest vantage point is
within reach / factor (sqrt(2) of it, if less than the reach it began with); reach is the largest distance at which
neighbours still matter. Each shard has a binary
vantage-point tree over all its vectors (inside or outside the median distance to a vantage point; the other side is
visited where |distance - radius| <= reach / factor), searched for batches of queries at once, with the reach shrinking
to the k-th best distance found. With factor 1 the triangle inequality proves that nothing is lost; a larger factor
visits fewer places and may miss neighbours. Where all vectors are queries, a pair met on a visit counts for both.

Visits are made in rounds of at most about ROUND per vector, each of which frees its files, so that the disk in use stays
in proportion to the input however many visits there are.

Defined results: vectors that are null, of another length than `dim`, all zero, or hold null or non-finite numbers take
no part. Vectors equal after scaling (to 1e-6 in every component, i.e. cosines above 1 - 1e-10) are indexed once and
count as equal; ties in similarity go to the smaller doc_id. A collection of one vector has no neighbours. Extra
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon import session
from quillon.session import free, join_hot, join_small, wide

#: Rows the routing tree is fitted on at most. All rows are indexed.
SAMPLE = 20_000
#: Distinct vectors per shard, on average.
SHARD = 8_000
LEAF = 256
#: A shard of more than LARGE * SHARD vectors is split again, by a tree fitted on about this number of its rows.
LARGE, OWN_SAMPLE = 3, 8_000
#: Queries from elsewhere that one task answers in a shard, about.
VISITORS = 20_000
#: Visits per vector in one round, about.
ROUND = 4
SLACK = 1e-7
#: Numbers in one matrix of distances to vantage points.
CELLS = 1_000_000

settle = partial(session.settle, lean=True)


def _distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ v), 0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> int:
    """Of a few candidates the one whose distances spread most."""
    tries = rng.choice(len(x), min(8, len(x)), replace=False)
    some = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    return int(tries[np.argmax(np.std(np.sqrt(np.maximum(2 - 2 * some @ x[tries].T, 0)), axis=0))])


def _vantages(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """At most n vantage points, each in the middle of the rows nearest to it."""
    u = x[rng.choice(len(x), n, replace=False)]
    for _ in range(8):
        near = _nearest(x, u)
        u = np.zeros_like(u)
        np.add.at(u, near, x)
        long = np.linalg.norm(u, axis=1)
        u = u[long > 1e-6] / long[long > 1e-6, None]
    return u[np.unique(_nearest(x, u))]


def _nearest(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(u))
    return np.concatenate([np.argmax(x[s : s + step] @ u.T, axis=1) for s in range(0, len(x), step)])


def routing_tree(x: np.ndarray, shards: int, rng: np.random.Generator):
    """(vantage vectors, a place for each); a place is a node or a shard number. A lone leaf if x can't be split."""
    n = min(shards, len(x) // 16)
    if n < 2:
        return 0
    u = _vantages(x, n, rng)
    return (u, tuple(range(len(u)))) if len(u) > 1 else 0


def graft(tree, grown: dict[int, bytes], numbers: Iterator[int]):
    """The tree with the leaves in `grown` replaced by trees, whose leaves get new numbers."""

    def renumber(node):
        return next(numbers) if isinstance(node, int) else (node[0], tuple(map(renumber, node[1])))

    if isinstance(tree, int):
        return renumber(pickle.loads(grown[tree])) if tree in grown else tree
    return tree[0], tuple(graft(t, grown, numbers) for t in tree[1])


def route(tree, x: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) pairs; home shards only if there is no reach, else all shards within it. A vector of a place is at
    least as near to its vantage point c as to the one b that is nearest to the query, so the query is within
    (q b - q c) / |b - c| of it, the distance to the plane between them."""
    rows, where = [], []

    def walk(node, at: np.ndarray) -> None:
        if isinstance(node, int):
            rows.append(at)
            where.append(np.full(len(at), node, np.int64))
            return
        u, places = node
        between = np.sqrt(np.maximum(2 - 2 * (u @ u.T), 0))
        step = max(1, CELLS // len(u))
        to: list[list[np.ndarray]] = [[] for _ in places]
        for s in range(0, len(at), step):
            a = at[s : s + step]
            dots = x[a] @ u.T
            home = np.argmax(dots, axis=1)
            if reach is None:
                i, c = np.arange(len(a)), home
            else:
                gap = dots[np.arange(len(a)), home][:, None] - dots
                i, c = np.nonzero(gap <= reach[a][:, None] * between[home] + SLACK)
            order = np.argsort(c, kind="stable")
            cuts = np.searchsorted(c[order], np.arange(len(places) + 1))
            for p in np.unique(c):
                to[p].append(a[i[order[cuts[p] : cuts[p + 1]]]])
        for place, parts in zip(places, to):
            if parts:
                walk(place, np.concatenate(parts))

    if len(x):
        walk(tree, np.arange(len(x)))
    return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(where) if where else np.empty(0, np.int64)


class VPTree:
    """Tree over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x, self.rng, self.leaf = x, np.random.default_rng(seed), leaf
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at, self.x[at]
        v = self.x[at[_vantage(self.x[at], self.rng)]]
        d = _distance(self.x[at], v)
        radius = float(np.median(d))
        near = d <= radius
        if near.all():
            return at, self.x[at]
        return v, radius, self._grow(at[near]), self._grow(at[~near])

    def search(self, q: np.ndarray, k: int, reach: float, factor: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, row), each (len(q), k), best first; rows missing are -1. own: row of the query itself, or -1."""
        sim = np.full((len(q), k), 1 - reach**2 / 2 - 1e-12)
        row = np.full((len(q), k), -1, np.int64)
        floor = sim.copy()

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 2:
                ids, x = node
                for s in range(0, len(at), 4096):
                    a = at[s : s + 4096]
                    found = q[a] @ x.T
                    mine = own[a]
                    hit = found >= sim[a, k - 1][:, None]
                    busy = np.flatnonzero(hit.any(axis=1))
                    if not len(busy):
                        continue
                    a, found, mine = a[busy], found[busy], mine[busy]
                    found[ids[None, :] == mine[:, None]] = -2
                    some = np.concatenate([sim[a], found], axis=1)
                    rows = np.concatenate([row[a], np.broadcast_to(ids, found.shape)], axis=1)
                    top = np.argsort(-some, axis=1, kind="stable")[:, :k]
                    line = np.arange(len(a))[:, None]
                    sim[a], row[a] = some[line, top], rows[line, top]
                return
            v, radius, inner, outer = node
            d = _distance(q[at], v)
            near = d <= radius
            visit(inner, at[near])
            visit(outer, at[~near])
            cross = np.abs(d - radius) <= np.sqrt(np.maximum(2 - 2 * sim[at, k - 1], 0)) / factor + SLACK
            visit(outer, at[near & cross])
            visit(inner, at[~near & cross])

        visit(self.root, np.arange(len(q)))
        row[sim < floor] = -1
        return sim, row


def usable_vectors(documents: DataFrame, dim: int = 64, column: str = "embedding") -> DataFrame:
    """doc_id, v: usable vectors, as 32-bit numbers, and a digest that vectors equal after scaling share."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            x = raw.astype(np.float64)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[ok]
            same = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * 1e6).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in raw[ok]], pa.binary()), pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in same], pa.binary())], names=["doc_id", "v", "same"]
            )

    usable = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("array<float>").alias("e")).where((F.size("e") == dim) & ~F.exists("e", lambda x: x.isNull()))
    return usable.mapInArrow(scale, "doc_id long, v binary, same binary")


def _stack(column) -> np.ndarray:
    """Unit vectors."""
    raw = [x if isinstance(x, bytes) else bytes(x) for x in column]
    if not raw:
        return np.empty((0, 1))
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pieces(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Slices of the batches in which the keys don't change."""
    for b in batches:
        if len(b):
            k = b[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                yield tuple(k[lo]), b.iloc[lo:hi]


class _Shard:
    """Tree over the rows of a shard, and its search."""

    def __init__(self, rows: list[pd.DataFrame]):
        rows = pd.concat(rows)
        order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
        self.ids = rows["doc_id"].to_numpy()[order]
        self.x = _stack(rows["v"])[order]
        self.tree = VPTree(self.x)

    def search(self, q: np.ndarray, who: np.ndarray, k: int, reach: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        spot = np.minimum(np.searchsorted(self.ids, who), len(self.ids) - 1)
        sim, row = self.tree.search(q, k, reach, factor, np.where(self.ids[spot] == who, spot, -1))
        return sim, np.where(row >= 0, self.ids[np.maximum(row, 0)], -1)


def _split_again(placed: DataFrame, tree, shard: int) -> tuple | int | None:
    """The tree with its large leaves split by trees fitted on samples of their vectors; None if there is no large one.
    Only counts of shards and the new trees (a vector per shard) reach the driver."""
    sizes = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    large = [(s, min(1.0, OWN_SAMPLE / n), -(-n // shard)) for s, n in sizes.items() if n > LARGE * shard]
    if not large:
        return None
    spark = placed.sparkSession
    some = placed.join(F.broadcast(spark.createDataFrame(large, "shard long, share double, parts long")), "shard").where(F.rand(3) < F.col("share"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        grown = routing_tree(_stack(rows["v"]), int(rows["parts"].iloc[0]), np.random.default_rng(2))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "tree": [b"" if isinstance(grown, int) else pickle.dumps(grown)]})

    grown = {r["shard"]: bytes(r["tree"]) for r in some.groupBy("shard").applyInPandas(fit, "shard long, tree binary").collect() if r["tree"]}
    return graft(tree, grown, iter(range(max(sizes) + 1, 1 << 40))) if grown else None


def nearest(documents: DataFrame, k: int = 5, min_cosine: float | None = None, factor: float = 4.0, queries=None, dim: int = 64, column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """doc_id, neighbour_id, cosine, rank 1..k: for every vector (or those of which the condition `queries` on doc_id
    holds) its most similar other ones, of at least `min_cosine` if given. Two steps: the home shard first, then the
    shards within the distance of the k-th best found so far. Each shard goes to a partition of its own; where very many
    queries visit a shard, several tasks share them, and visits beyond ROUND per vector wait for further rounds."""
    spark = documents.sparkSession
    table = settle(usable_vectors(documents, dim, column))
    heads = Window.partitionBy("same").orderBy("doc_id")
    several = settle(table.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    # the k + 1 smallest ids of each group of copies, kept while partial results are merged, so no group is gathered
    members = settle(join_hot(table.select("same", "doc_id"), several, "same", "copies", F.col("doc_id")).select("same", "rep", "doc_id", "copies"))
    parts = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(256)))
    few = parts.withColumn("n", F.row_number().over(Window.partitionBy("same", "part").orderBy("doc_id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(heads)).where(F.col("n") <= k + 1)
    head = settle(few.groupBy("rep").agg(F.sort_array(F.collect_list("doc_id")).alias("head")))
    further = settle(members.where("doc_id <> rep").select("doc_id"))
    reps = settle(join_small(table.select("doc_id", "v"), further, "doc_id", "left_anti"))
    count = reps.count()
    tree = 0
    if count > shard:
        sample = reps.sample(min(1.0, 1.2 * SAMPLE / count), seed=7).limit(SAMPLE).select("v").collect()
        tree = routing_tree(_stack([r[0] for r in sample]), -(-count // shard), np.random.default_rng(1))
    wanted = None if queries is None else settle(join_hot_queries(table, members, queries))
    free(table, several, further)
    both_ways = queries is None
    reach = 2.0 if min_cosine is None else float(np.sqrt(2 - 2 * min_cosine))

    def place(tree) -> DataFrame:
        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows, where = route(tree, _stack(b["v"]), None)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[rows], "v": b["v"].to_numpy()[rows], "ask": b["ask"].to_numpy()[rows], "shard": where})

        ask = reps.withColumn("ask", F.lit(True)) if wanted is None else reps.join(wanted.withColumn("ask", F.lit(True)), "doc_id", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        return settle(ask.select("doc_id", "v", "ask").mapInPandas(home, "doc_id long, v binary, ask boolean, shard long"))

    placed = place(tree)
    while (more := _split_again(placed, tree, shard)) is not None:
        tree = more
        free(placed)
        placed = place(tree)
    free(reps)
    single = settle(join_small(placed.select("doc_id"), settle(members.select("doc_id")), "doc_id", "left_anti"))

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def searched(number: int, rows: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = pd.concat([r[r["ask"]] for r in rows])
            if not len(asked):
                return
            here = _Shard(rows)
            for lo in range(0, len(asked), 10_000):
                some = asked.iloc[lo : lo + 10_000]
                q, who = _stack(some["v"]), some["doc_id"].to_numpy()
                sim, near = here.search(q, who, k, reach, factor)
                # a distance to a far vantage point changes by less than that to a plane, about by 1 / sqrt(2) of it
                left = np.minimum(np.sqrt(np.maximum(4 - 4 * sim[:, -1], 0)), reach)
                at, where = route(tree, q, left / factor)
                visits: list[list[int]] = [[] for _ in who]
                for i, s in zip(at.tolist(), where.tolist()):
                    if s != number:
                        visits[i].append(s)
                yield pd.DataFrame({"doc_id": who, "near": list(near), "sim": list(sim), "v": [v if w else None for v, w in zip(some["v"], visits)], "visits": visits})

        held: list[pd.DataFrame] = []
        now = None
        for (number,), piece in _pieces(batches, ["shard"]):
            if held and number != now:
                yield from searched(now, held)
                held = []
            now = number
            held.append(piece)
        if held:
            yield from searched(now, held)

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now, here = None, None
        for (number, salt, visitor), piece in _pieces(batches, ["shard", "salt", "visitor"]):
            if (number, salt) != now:
                now, here, held = (number, salt), None, []
            if not visitor:
                held.append(piece)
                continue
            if here is None:
                here = _Shard(held)
                held = []
            who, bound = piece["doc_id"].to_numpy(), piece["bound"].to_numpy()
            sim, near = here.search(_stack(piece["v"]), who, k, float(bound.max()), factor)
            i, j = np.nonzero((near >= 0) & ((sim >= 1 - bound[:, None] ** 2 / 2 - 1e-12) | both_ways))
            hit = pd.DataFrame({"doc_id": who[i], "near": near[i, j], "sim": sim[i, j]})
            yield hit
            if both_ways:
                back = hit.set_axis(["near", "doc_id", "sim"], axis=1).sort_values(["doc_id", "sim", "near"], ascending=[True, False, True])
                yield back[back.groupby("doc_id").cumcount() < k][["doc_id", "near", "sim"]]

    shards = placed.agg(F.max("shard")).first()[0] or 0
    n = wide(spark, min(shards + 1, 100_000))
    own = placed.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard")
    first = settle(own.mapInPandas(at_home, "doc_id long, near array<long>, sim array<double>, v binary, visits array<long>"))
    hits = first.select("doc_id", F.explode(F.arrays_zip("near", "sim")).alias("h")).select("doc_id", "h.near", "h.sim").where("near >= 0")
    if shards:
        far = first.where("v is not null").select("doc_id", "v", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.element_at("sim", -1))).alias("bound"), F.explode("visits").alias("shard"))
        tally = settle(first.select(F.explode("visits").alias("shard")).groupBy("shard").count().withColumn("salts", F.ceil(F.col("count") / VISITORS).cast("int")))
        rounds = int(max(1, -(-(tally.agg(F.sum("count")).first()[0] or 0) // (ROUND * count))))
        of_round = F.pmod("shard", F.lit(rounds)).cast("int")
        further = dict(tally.groupBy(of_round).agg(F.sum(F.col("salts") - 1)).collect())
        crowd = F.broadcast(tally.where("salts > 1").select("shard", "salts"))  # at most visits / VISITORS rows
        salts = F.coalesce("salts", F.lit(1))
        for r in range(rounds):
            n = wide(spark, min(shards // rounds + 1 + (further.get(r) or 0), 100_000))
            base = placed.where(of_round == r).join(crowd, "shard", "left").select("doc_id", "v", F.lit(0.0).alias("bound"), "shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("visitor"))
            guests = far.where(of_round == r).join(crowd, "shard", "left").select("doc_id", "v", "bound", "shard", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), F.lit(1).alias("visitor"))
            # the tasks of a crowded shard lie apart
            to = F.pmod(F.floor(F.col("shard") / rounds) + F.col("salt") * 7919, F.lit(n)).cast("int")
            both = base.unionByName(guests).repartitionById(n, to).sortWithinPartitions("shard", "salt", "visitor")
            met = settle(_best(both.mapInPandas(visiting, "doc_id long, near long, sim double"), k))
            hits = hits.unionByName(met)
    out = _spread(hits, members, head, single if wanted is None else single.join(wanted, "doc_id", "left_semi"), k, min_cosine, queries)
    free(first, placed, head)
    return out


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each doc_id; a pair met twice counts once."""
    once = hits.repartition("doc_id").groupBy("doc_id", "near").agg(F.max("sim").alias("sim"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sim"), "near"))).where(F.col("n") <= k).drop("n")


def join_hot_queries(table: DataFrame, members: DataFrame, queries) -> DataFrame:
    """The representatives to ask for: those of which any copy is a query."""
    asked = table.where(queries).select("doc_id")
    copies = members.where(queries).select(F.col("rep").alias("doc_id")).distinct()
    return asked.join(members.select("doc_id"), "doc_id", "left_anti").unionByName(copies).distinct()


def _spread(hits: DataFrame, members: DataFrame, head: DataFrame, single: DataFrame, k: int, min_cosine: float | None, queries) -> DataFrame:
    """From neighbours between representatives to k neighbours of every copy."""
    best = _best(hits, k).withColumnRenamed("doc_id", "rep")
    # a neighbour stands for itself and its first copies
    wide_ = best.join(head.withColumnRenamed("rep", "near"), "near", "left").select("rep", F.explode(F.coalesce("head", F.array("near"))).alias("near"), F.least(F.lit(1.0), "sim").alias("cosine"))
    copies = head.select("rep", F.explode("head").alias("near"), F.lit(1.0).alias("cosine"))
    order = Window.partitionBy("rep").orderBy(F.desc("cosine"), "near")
    lists = wide_.unionByName(copies).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = settle(lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "near", "cosine"))).alias("near")))
    rows = single.select(F.col("doc_id").alias("rep"), "doc_id").unionByName(members.select("rep", "doc_id") if queries is None else members.where(queries).select("rep", "doc_id"))
    each = rows.join(lists, "rep").select("doc_id", F.slice(F.filter("near", lambda h: h["near"] != F.col("doc_id")), 1, k).alias("near"))
    out = each.select("doc_id", F.posexplode("near").alias("p", "h")).select("doc_id", F.col("h.near").alias("neighbour_id"), F.col("h.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))
    return out if min_cosine is None else out.where(F.col("cosine") >= min_cosine)


def similar_vector_pairs(documents: DataFrame, k: int = 5, min_cosine: float = 0.9, factor: float = 3.0, **more) -> DataFrame:
    """doc_id_a < doc_id_b: pairs of at least min_cosine of which one is among the k most similar of the other."""
    near = nearest(documents, k, min_cosine, factor, **more)
    return near.select(F.least("doc_id", "neighbour_id").alias("doc_id_a"), F.greatest("doc_id", "neighbour_id").alias("doc_id_b"), "cosine").groupBy("doc_id_a", "doc_id_b").agg(F.max("cosine").alias("cosine"))
