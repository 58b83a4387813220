"""The retrieval engine: one collection with its embedder, and the ways to query it. Results are DataFrames with a rank."""

from __future__ import annotations

import asyncio
import logging
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.functions.columns import citation, condition, content_id
from quillon.operators import graph as kg
from quillon.operators import prompt as prompts
from quillon.operators.collection import Collection
from quillon.operators.embed import EmbeddingBackend, EmbeddingCache, HashingBackend, embedded
from quillon.operators import evaluate as quality
from quillon.operators.keyword import KeywordIndex, bm25, fuse, ranks, vector_fetch
from quillon.operators.search import best_parent, merged, ranked, reranked, scorer, top_k
from quillon.timing import timed

log = logging.getLogger(__name__)


def document(text: str, metadata: dict[str, Any] | None = None, id: str | None = None) -> dict:
    """A document as add() takes it."""
    return {"text": text, "metadata": {k: str(v) for k, v in (metadata or {}).items()}, "id": id}


@runtime_checkable
class Store(Protocol):
    """What an Index keeps its rows in; Collection is one."""

    name: str
    metric: str

    def rows(self) -> DataFrame: ...

    def upsert(self, rows: DataFrame, arrival: str | None = None) -> None: ...

    def search(self, query: list[float], k: int = 5, where: dict[str, Any] | None = None) -> DataFrame: ...

    def delete(self, ids: list[str] | DataFrame) -> None: ...

    def count(self) -> int: ...

    def clear(self) -> None: ...


class Index:
    def __init__(self, spark: SparkSession, folder: str = "./quillon_db", collection: str = "documents", backend: EmbeddingBackend | None = None, metric: str = "l2sq", cache: int = 1024, batch_size: int = 64, store: Store | None = None, rerank_model: str = "lexical"):
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        self.spark, self.folder = spark, folder
        self.collection = store or Collection(spark, folder, collection, metric)
        self.scorer = scorer(rerank_model)
        self.backend = backend or HashingBackend()
        self.cache, self.batch_size = EmbeddingCache(cache), batch_size

    def embed(self, rows: DataFrame) -> DataFrame:
        return embedded(rows, self.backend, batch_size=self.batch_size)

    @timed("add")
    def add(self, documents: DataFrame | list[dict]) -> None:
        """Embed and upsert; an empty text raises before anything is written."""
        if isinstance(documents, list):
            if not documents:
                return
            rows = [(d.get("id"), d["text"], {k: str(v) for k, v in (d.get("metadata") or {}).items()}) for d in documents]
            documents = self.spark.createDataFrame(rows, "id string, text string, metadata map<string,string>")
            documents = documents.withColumn("id", F.coalesce("id", content_id("text")))
        # numbered before embedding, which may change the order of the rows
        numbered = documents.withColumn("_arrival_number", F.monotonically_increasing_id())
        self.collection.upsert(self.embed(numbered), "_arrival_number")

    def _vector(self, query: str, k: int) -> list[float]:
        if not query or not query.strip():
            raise ValueError("the query is empty")
        if k < 1:
            raise ValueError("top_k must be at least 1")
        return [float(x) for x in self.cache.get_or_compute([query], self.backend.encode)[0]]

    @staticmethod
    def shown(top: DataFrame, rerank: bool = False) -> DataFrame:
        order = F.desc("rerank_score") if rerank else None
        out = ranked(top, score=order)
        score = F.col("rerank_score") if "rerank_score" in top.columns else F.lit(None).cast("double")
        return out.select("rank", "id", "text", "metadata", "distance", score.alias("rerank_score"), citation(F.col("metadata"), F.col("id")).alias("citation"))

    @timed("query")
    def query(self, query: str, top_k: int = 5, where: dict | None = None, rerank: bool = False, score: Callable | None = None) -> DataFrame:
        top = self.collection.search(self._vector(query, top_k), 4 * top_k if rerank else top_k, where)
        if rerank:
            return self.shown(reranked(top, query, top_k, score or self.scorer), True)
        return self.shown(top)

    def _filtered(self, where: dict | None) -> DataFrame:
        rows = self.collection.rows()
        own = {"source_id": F.col("source_id"), "chunk_index": F.col("chunk_index")}
        return rows.where(condition(where, F.col("metadata"), own)) if where else rows

    def _lexical(self, rows: DataFrame, query: str, where: dict | None) -> DataFrame:
        """id, score of every row. Without a filter from the snapshot's keyword index, which the first query builds; with
        one the statistics are those of the rows that pass, so they are counted anew."""
        name = None if where else getattr(self.collection, "snapshot", lambda: None)()
        if name is None:
            return bm25(rows, query)
        index = KeywordIndex(self.spark, f"{self.collection.path}.keywords/{name}")
        if not index.exists():
            index.build(rows)
        found = index.scores(query).withColumnRenamed("key", "id")
        return rows.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def evaluate(self, queries: list[str], expected: list[list[str]], top_k: int = 10, standard_ndcg: bool = False) -> dict[str, float]:
        """queries, mrr, ndcg, recall of the results of each query against the ids expected for it."""
        if len(queries) != len(expected):
            raise ValueError("queries and expected must have the same length")
        wanted = self.spark.createDataFrame([(i, e) for i, ids in enumerate(expected) for e in ids], "query_id int, id string")
        found = self.spark.createDataFrame([], "query_id int, id string, rank int")
        for i, query in enumerate(queries):
            found = found.unionByName(self.query(query, top_k).select(F.lit(i).alias("query_id"), "id", "rank"))
        asked = self.spark.createDataFrame([(i,) for i in range(len(queries))], "query_id int")
        per = quality.evaluate(found, wanted, standard_ndcg)
        return quality.summary(asked.join(per, "query_id", "left").fillna(0.0)).first().asDict()

    @timed("hybrid")
    def hybrid_query(self, query: str, top_k: int = 5, where: dict | None = None, alpha: float = 0.5) -> DataFrame:
        v = self._vector(query, top_k)
        rows = self._filtered(where)
        words = ranks(self._lexical(rows, query, where), [F.desc("score"), F.col("id")])
        count = rows.count()
        fetch = vector_fetch(count, top_k, alpha)
        near = self.spark.createDataFrame([], "id string, rank long")
        if fetch:
            near = ranks(_nearest(rows, v, fetch, self.collection.metric), [F.col("distance"), F.col("id")], fetch)
        best = fuse(near, words, alpha).orderBy("distance", "id").limit(top_k)
        return self.shown(best.join(rows.select("id", "text", "metadata"), "id"))

    @timed("graph")
    def graph_query(self, query: str, mentions: DataFrame, edges: DataFrame, top_k: int = 5, where: dict | None = None, max_hops: int = 2, alpha: float = 0.5, rrf_k: int = 60) -> DataFrame:
        v = self._vector(query, top_k)
        rows = self._filtered(where)
        near = ranks(_nearest(rows, v, 2 * top_k, self.collection.metric), [F.col("distance"), F.col("id")], 2 * top_k)
        return self.shown(kg.graph_fusion(kg.graph_ranking(mentions, edges, query, max_hops), near, rows, top_k, alpha, rrf_k=rrf_k))

    @timed("parent")
    def query_parent(self, query: str, top_k: int = 5, where: dict | None = None, rerank: bool = False) -> DataFrame:
        """Nearest chunk of each parent among 3k chunks; reranking decides only which chunks these are."""
        v = self._vector(query, top_k)
        found = self.collection.search(v, 12 * top_k if rerank else 3 * top_k, where)
        if rerank:
            found = reranked(found, query, 3 * top_k, self.scorer)
        return self.shown(best_parent(found, self.collection.rows(), top_k))

    def query_for_prompt(self, query: str, top_k: int = 5, where: dict | None = None, template: str | None = None) -> str:
        return prompts.prompt(query, self.query(query, top_k, where), template or prompts.TEMPLATE)

    def query_stream(self, query: str, top_k: int = 5, **more) -> Iterator[Row]:
        return self.query(query, top_k, **more).orderBy("rank").toLocalIterator()

    async def aquery(self, query: str, top_k: int = 5, **more) -> list[Row]:
        return await asyncio.to_thread(lambda: self.query(query, top_k, **more).orderBy("rank").collect())

    async def ahybrid_query(self, query: str, top_k: int = 5, **more) -> list[Row]:
        return await asyncio.to_thread(lambda: self.hybrid_query(query, top_k, **more).orderBy("rank").collect())

    async def aadd(self, documents: DataFrame | list[dict]) -> None:
        await asyncio.to_thread(self.add, documents)

    def delete(self, ids: list[str]) -> None:
        self.collection.delete(ids)

    def count(self) -> int:
        return self.collection.count()

    def clear(self) -> None:
        self.collection.clear()
        self.cache.clear()


def _nearest(rows: DataFrame, v: list[float], k: int, metric: str) -> DataFrame:
    return top_k(rows, v, k, None, metric).select("id", "distance")


class Router:
    """Queries over several indexes; names without an index are skipped with a warning."""

    def __init__(self, indexes: dict[str, Index]):
        self.indexes = indexes

    def query(self, query: str, top_k: int = 5, collections: list[str] | None = None, **more) -> DataFrame:
        for name in collections or ():
            if name not in self.indexes:
                log.warning("no collection %s", name)
        names = [n for n in self.indexes if collections is None or n in collections]
        if not names:
            raise ValueError("no known collection")
        return merged({n: self.indexes[n].query(query, top_k, **more) for n in names}, top_k)


class Pipeline:
    """load -> split -> add. on_error: 'skip' (log), 'raise', or a function of (error, stage); a failed stage ends the run."""

    def __init__(self, loader: Callable[..., DataFrame], index: Index, splitter: Callable[[DataFrame], DataFrame] | None = None, on_error: str | Callable = "skip"):
        self.loader, self.index, self.splitter, self.on_error = loader, index, splitter, on_error
        self.stats = dict.fromkeys(("loaded", "chunked", "indexed", "errors"), 0)

    def run(self, *args, **kwargs) -> dict[str, int]:
        self.stats = dict.fromkeys(self.stats, 0)
        rows, stage = None, ""
        held: list[DataFrame] = []
        try:
            for stage in ("loaded", "chunked", "indexed"):
                if stage == "loaded":
                    rows = self.loader(*args, **kwargs).persist()
                    held.append(rows)
                    self.stats[stage] = rows.count()  # a lazy failure belongs to the stage that caused it
                elif stage == "chunked":
                    if self.splitter is not None:
                        rows = self.splitter(rows).persist()
                        held.append(rows)
                    self.stats[stage] = rows.count()
                else:
                    self.index.add(rows)
                    self.stats[stage] = self.stats["chunked"]
        except Exception as e:
            self.stats["errors"] += 1
            if self.on_error == "raise":
                raise
            if callable(self.on_error):
                self.on_error(e, stage)
            else:
                log.warning("%s failed: %s", stage, e)
        finally:
            for df in held:
                df.unpersist()
        return dict(self.stats)

    def query(self, query: str, top_k: int = 5, **more) -> DataFrame:
        return self.index.query(query, top_k, **more)

    def query_stream(self, query: str, top_k: int = 5, **more) -> Iterator[Row]:
        return self.index.query_stream(query, top_k, **more)
