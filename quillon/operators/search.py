"""Vector search: top k for one query, for many queries, per group, over several collections; reranking; parents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import distance, doubles, vector, words
from quillon.session import settle, wide

#: Queries and rows in one block of the kNN join: a matrix of their distances is 32 MB.
QUERY_BLOCK, ROW_BLOCK = 1_000, 4_000
#: Digits that ranking goes by, beyond the precision of the vectors, so that equal vectors tie; results show six.
DIGITS = 12


def top_k(rows: DataFrame, query: list[float] | Column, k: int, where: Column | None = None, metric: str = "l2sq", embedding: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows with the smallest distance, ties by key: filter first, then rank. Plans as TakeOrderedAndProject, i.e. a
    bounded heap per task and one small merge. Rows without a vector of the query's length are left out."""
    if k < 1:
        raise ValueError("k must be at least 1")
    q = vector(query) if isinstance(query, list) else query
    kept = rows if where is None else rows.where(where)
    scored = _scored(kept, q, metric, embedding).where("not isnan(distance)")
    return scored.orderBy("distance", key).limit(k)


def _scored(rows: DataFrame, q: Column, metric: str, embedding: str) -> DataFrame:
    return rows.withColumn("distance", F.round(distance(F.col(embedding), q, metric), DIGITS) + F.lit(0.0)).where("distance is not null")


def ranked(top: DataFrame, key: str = "id", score: Column | None = None) -> DataFrame:
    """Adds rank 1.. to a result of at most k rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("distance") if score is None else score, key)))


def post_filtered(rows: DataFrame, query: list[float] | Column, k: int, where: Column, metric: str = "l2sq", embedding: str = "embedding", key: str = "id") -> DataFrame:
    """The k of the 4k nearest for which the condition holds; may find fewer than there are."""
    return top_k(rows, query, 4 * k, None, metric, embedding, key).where(where).orderBy("distance", key).limit(k)


def top_k_per_group(rows: DataFrame, query: list[float] | Column, group: str, k: int, metric: str = "l2sq", embedding: str = "embedding", key: str = "id") -> DataFrame:
    """Best k of each group. Catalyst limits each group before the shuffle (WindowGroupLimit), so hot groups stay small."""
    q = vector(query) if isinstance(query, list) else query
    scored = _scored(rows, q, metric, embedding)
    w = Window.partitionBy(group).orderBy("distance", key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, embedding: str, size: int) -> DataFrame:
    """block, dim, keys, x: rows packed into matrices of at most `size` rows of one length."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(v) for v in b.column(1)], np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for lo in range(0, len(at), size):
                    some = b.take(pa.array(at[lo : lo + size]))
                    x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    keys = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), keys, pa.array([x.tobytes()], pa.binary())], names=["dim", "keys", "x"])

    usable = rows.select(key, doubles(embedding).alias("_v")).where(F.col(key).isNotNull() & (F.size("_v") > 0))
    return usable.mapInArrow(pack, f"dim int, keys array<{kind}>, x binary").withColumn("block", F.monotonically_increasing_id())


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2sq":
        d = np.zeros((len(q), len(x)))
        for i in range(q.shape[1]):  # by differences: the product formula loses digits of near vectors
            d += (q[:, i, None] - x[None, :, i]) ** 2
        return d
    d = -q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        d = 1 + np.divide(d, n, out=np.zeros_like(d), where=n > 0)
    return d


def knn_join(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", embedding: str = "embedding", query_key: str = "query_id", key: str = "id") -> DataFrame:
    """query_key, key, distance, rank for a stated set of queries against all rows of the same length. Both sides are
    packed into blocks; every block of queries meets every block of rows once, spread by the latter over all tasks,
    where a matrix of distances leaves k rows per query. Nothing passes through the driver, and rows are read once."""
    spark = rows.sparkSession
    asked = settle(_blocks(queries, query_key, embedding, QUERY_BLOCK).select("dim", F.col("block").alias("q_block"), F.col("keys").alias("q_keys"), F.col("x").alias("q")))
    salts = wide(spark)
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = _blocks(rows, key, embedding, ROW_BLOCK).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    met = own.join(spread, ["dim", "salt"]).select("dim", "q_keys", "q", "keys", "x")
    kinds = [queries.schema[query_key].dataType.simpleString(), rows.schema[key].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, q_keys, q, keys, x = (batch.column(i)[r] for i in range(5))
                q, x = (np.frombuffer(m.as_py(), np.float64).reshape(-1, dim.as_py()) for m in (q, x))
                d = np.round(_distances(q, x, metric), DIGITS) + 0.0
                # all ties of the k-th, so that the smaller key can win
                most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else d.max(axis=1)
                i, j = np.nonzero(d <= most[:, None])
                place = np.empty(len(x), np.int64)
                place[np.argsort(np.array(keys.as_py(), dtype=object), kind="stable")] = np.arange(len(x))
                order = np.lexsort((place[j], d[i, j], i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, np.arange(len(q)))
                keep = np.arange(len(i)) - first[i] < k
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([q_keys.values.take(pa.array(i)), keys.values.take(pa.array(j)), pa.array(d[i, j])], names=[query_key, key, "distance"])

    found = met.mapInArrow(run, f"{query_key} {kinds[0]}, {key} {kinds[1]}, distance double")
    w = Window.partitionBy(query_key).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged(results: dict[str, DataFrame], k: int, only: list[str] | None = None, key: str = "id") -> DataFrame:
    """Federated merge: results of several collections, tagged with `_collection`, by distance; unknown names are skipped."""
    tagged = [df.withColumn("_collection", F.lit(name)) for name, df in results.items() if only is None or name in only]
    if not tagged:
        raise ValueError("no known collection")
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.orderBy("distance", "_collection", key).limit(k)


def lexical_score(query: str, text: Column | str) -> Column:
    """Share of the query's distinct words that the text has: a deterministic stand-in for a cross-encoder."""
    wanted = sorted(set(query.lower().split()))
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in wanted]), words(text))) / F.lit(float(len(wanted)))


class CrossEncoder:
    """Scores (query, text) pairs with a sentence-transformers cross-encoder, loaded once per worker when first used."""

    def __init__(self, model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"):
        self.model = model

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        return [float(x) for x in _loaded(self.model).predict([(query, t) for t in texts])] if texts else []


@lru_cache(maxsize=4)
def _loaded(model: str):
    try:
        from sentence_transformers import CrossEncoder as Model
    except ImportError as e:
        raise ImportError("reranking by a cross-encoder needs the package sentence-transformers") from e
    return Model(model)


def scorer(name: str | None) -> Callable[[str, list[str]], list[float]] | None:
    """The scoring function of a configured name: none for the lexical score, else a cross-encoder of that name."""
    return None if name in (None, "", "lexical") else CrossEncoder(name)


def reranked(top: DataFrame, query: str, k: int, score: Callable[[str, list[str]], list[float]] | None = None, key: str = "id") -> DataFrame:
    """By falling rerank_score (then distance, key). score: (query, texts) to numbers, run in Arrow batches on few rows."""
    if score is None:
        column = lexical_score(query, "text")
    else:

        @F.pandas_udf("double")
        def model(texts: pd.Series) -> pd.Series:
            return pd.Series([float(s) for s in score(query, texts.tolist())])

        column = model("text")
    return top.withColumn("rerank_score", F.round(column, 6)).orderBy(F.desc("rerank_score"), "distance", key).limit(k)


def best_parent(chunks: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """Of each parent its nearest chunk; the parent's row where it is stored, else the chunk's."""
    parent = F.coalesce("source_id", "id")
    w = Window.partitionBy("_parent").orderBy("distance", "id")
    best = chunks.withColumn("_parent", parent).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    stored = parents.select(F.col("id").alias("_parent"), F.col("text").alias("_text"), F.col("metadata").alias("_metadata"), F.lit(True).alias("_stored"))
    joined = best.join(stored, "_parent", "left")
    pick = lambda a, b: F.when(F.col("_stored"), F.col(a)).otherwise(F.col(b))
    return joined.select(pick("_parent", "id").alias("id"), pick("_text", "text").alias("text"), pick("_metadata", "metadata").alias("metadata"), "distance").orderBy("distance", "id").limit(k)
