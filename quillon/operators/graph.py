"""Knowledge graph: entities of texts, co-occurrence edges, bounded breadth-first search, related documents, fusion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.keyword import fuse
from quillon.session import join_hot, join_small, settle

#: Fixed pattern: runs of capitalised words.
ENTITY = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
#: Words that begin sentences and are no entities by themselves.
STOP = (
    "The This That These Those Here There When Where Which What Who How However Also But And For From With About After Before "
    "Between Into Through During Without Again Further Then Once Each Every Both Few More Most Other Some Such Only Same Than "
    "Very Just Because Since While Although Though If Unless Until So Not No Nor As At By In Of On Or An Is It Its Do Did Has "
    "Had Have May Can Could Should Would Will Shall Must Need"
).split()


def entity_names(text: Column | str, min_length: int = 2) -> Column:
    """Entities in order of appearance, repeated ones included."""
    if min_length < 1:
        raise ValueError("min_length must be at least 1")
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))
    return F.filter(found, lambda e: (F.length(e) >= min_length) & ~e.isin(STOP))


def entity_mentions(documents: DataFrame, min_length: int = 2, extract=entity_names) -> DataFrame:
    """id, pos, name, key (lower case): one row per mention. extract: text column to array column, replaceable."""
    found = documents.where("text is not null").select("id", F.posexplode(extract(F.col("text"), min_length)).alias("pos", "name"))
    return found.withColumn("key", F.lower("name"))


def graph_nodes(mentions: DataFrame) -> DataFrame:
    """key, name (spelling of the first mention by id and position), type, doc_ids, documents."""
    first = F.min_by("name", F.struct("id", "pos"))
    return mentions.groupBy("key").agg(first.alias("name"), F.lit("CONCEPT").alias("type"), F.array_sort(F.collect_set("id")).alias("doc_ids"), F.countDistinct("id").alias("documents"))


def graph_edges(mentions: DataFrame, doc_ids: bool = True) -> DataFrame:
    """src < dst, weight = number of documents that have both, and these documents. Pairs are formed per document from its
    distinct keys; AQE splits documents with very many of them."""
    own = mentions.select("id", "key").distinct()
    pairs = own.alias("a").join(own.alias("b"), F.expr("a.id = b.id and a.key < b.key")).select(F.col("a.key").alias("src"), F.col("b.key").alias("dst"), F.col("a.id").alias("id"))
    out = [F.count("*").alias("weight")] + ([F.array_sort(F.collect_set("id")).alias("doc_ids")] if doc_ids else [])
    return pairs.groupBy("src", "dst").agg(*out)


def listed_nodes(entities: DataFrame) -> DataFrame:
    """Nodes from a table of name, entity_type, doc_ids with several rows per entity: key, type, doc_ids, documents."""
    rows = entities.where("name is not null").select(F.lower("name").alias("key"), F.upper("entity_type").alias("type"), F.explode_outer("doc_ids").alias("id"))
    return rows.groupBy("key").agg(F.max("type").alias("type"), F.array_sort(F.collect_set("id")).alias("doc_ids"), F.countDistinct("id").alias("documents"))


def listed_edges(relationships: DataFrame) -> DataFrame:
    """Edges from a table of source, target, doc_ids in any case and order: src < dst, weight (distinct documents)."""
    rows = relationships.where("source is not null and target is not null").select(F.least(F.lower("source"), F.lower("target")).alias("src"), F.greatest(F.lower("source"), F.lower("target")).alias("dst"), F.explode("doc_ids").alias("id"))
    return rows.where("src <> dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("weight"))


def neighbours(edges: DataFrame, start: str | list[str] | DataFrame, max_hops: int = 1) -> DataFrame:
    """key, hop of every node within max_hops of the start (which is left out; several starts: the smallest hop).
    One join of the frontier per hop; what is visited grows as a settled table, so plans stay short."""
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    spark = edges.sparkSession
    both = edges.select(F.col("src").alias("key"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("key"), F.col("src").alias("to")))
    if not isinstance(start, DataFrame):
        names = [start] if isinstance(start, str) else start
        start = spark.createDataFrame([(n.lower(),) for n in names], "key string")
    seen = start.select("key").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("key")
    for hop in range(1, max_hops + 1):
        found = both.join(frontier, "key", "left_semi").select(F.col("to").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        found = settle(found.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(found)
        frontier = found.select("key")
    return seen.where("hop > 0")


def related_documents(mentions: DataFrame, edges: DataFrame, name: str, max_hops: int = 2) -> DataFrame:
    """id, hop: documents of the entity itself (hop 0) and of its neighbours, each once with the smallest hop."""
    key = name.lower()
    spark = edges.sparkSession
    own = spark.createDataFrame([(key, 0)], "key string, hop int")
    near = own.unionByName(neighbours(edges, key, max_hops))
    return mentions.select("key", "id").distinct().join(near, "key").groupBy("id").agg(F.min("hop").alias("hop"))


def query_seeds(query: str, extract=None) -> list[str]:
    """Keys to look for: entities of the query in order, then its single words, each once."""
    import re

    found = [e for e in re.findall(ENTITY.removeprefix("(?U)"), query) if len(e) >= 2 and e not in STOP] if extract is None else extract(query)
    return list(dict.fromkeys([e.lower() for e in found] + [w.lower() for w in query.split()]))


def graph_ranking(mentions: DataFrame, edges: DataFrame, query: str, max_hops: int = 2) -> DataFrame:
    """id, rank from 0: documents related to the query's entities, in the order of the seeds, then hops, then ids."""
    seeds = query_seeds(query)
    spark = edges.sparkSession
    rows = mentions.select("key", "id").distinct()
    out = None
    for order, seed in enumerate(seeds):
        near = spark.createDataFrame([(seed, 0)], "key string, hop int").unionByName(neighbours(edges, seed, max_hops))
        part = rows.join(near, "key").groupBy("id").agg(F.min("hop").alias("hop")).withColumn("seed", F.lit(order))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "id string, rank long")
    best = out.groupBy("id").agg(F.min(F.struct("seed", "hop")).alias("b"))
    from quillon.operators.keyword import ranks

    return ranks(best.select("id", "b.seed", "b.hop"), [F.col("seed"), F.col("hop"), F.col("id")]).select("id", "rank")


def graph_fusion(graph: DataFrame, vectors: DataFrame, documents: DataFrame, k: int, alpha: float = 0.5, where: Column | None = None, strict: bool = False, rrf_k: int = 60) -> DataFrame:
    """Fuses a graph ranking with a vector ranking (id, rank from 0 each), without the rank offset of hybrid search.
    Documents that are missing or filtered out are dropped before the limit; with `strict`, after it."""
    scored = fuse(graph, vectors, alpha, k=rrf_k, offset=0)
    known = documents if where is None else documents.where(where)
    if strict:
        scored = scored.orderBy("distance", "id").limit(k)
    return scored.join(known.select("id", "text", "metadata"), "id").orderBy("distance", "id").limit(k)


class KnowledgeGraph:
    """Entities and co-occurrence edges of documents (id, text), grown by adding documents; a document added again is
    replaced. Mentions are kept as a settled table; nodes and edges follow from them."""

    def __init__(self, spark: SparkSession, extract=entity_names, min_length: int = 2):
        self.spark, self.extract, self.min_length = spark, extract, min_length
        self.mentions = self._none()

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "id string, pos int, name string, key string")

    def add(self, documents: DataFrame) -> None:
        new = settle(entity_mentions(documents, self.min_length, self.extract).select(F.col("id").cast("string").alias("id"), "pos", "name", "key"))
        kept = self.mentions.join(documents.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
        self.mentions = settle(kept.unionByName(new))

    def nodes(self) -> DataFrame:
        return graph_nodes(self.mentions)

    def edges(self) -> DataFrame:
        return graph_edges(self.mentions)

    def counts(self) -> dict[str, int]:
        return {"entities": self.mentions.select("key").distinct().count(), "edges": graph_edges(self.mentions, doc_ids=False).count()}

    def entity(self, name: str) -> DataFrame:
        """The node of that name in any case, or no row."""
        return graph_nodes(self.mentions.where(F.col("key") == name.lower()))

    def neighbours(self, name: str, max_hops: int = 1) -> DataFrame:
        return neighbours(graph_edges(self.mentions, doc_ids=False), name, max_hops)

    def related(self, name: str, max_hops: int = 2) -> DataFrame:
        return related_documents(self.mentions, graph_edges(self.mentions, doc_ids=False), name, max_hops)

    def clear(self) -> None:
        self.mentions = self._none()


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object of entities and edges (keyed by both ends joined with two bars), streamed row by row."""
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"entities": {')
        for i, n in enumerate(nodes.orderBy("key").toLocalIterator()):
            f.write((", " if i else "") + json.dumps(n["key"], ensure_ascii=False) + ": " + json.dumps({"name": n["name"], "type": n["type"], "doc_ids": sorted(n["doc_ids"])}, ensure_ascii=False))
        f.write('}, "edges": {')
        for i, e in enumerate(edges.orderBy("src", "dst").toLocalIterator()):
            f.write((", " if i else "") + json.dumps(f"{e['src']}||{e['dst']}", ensure_ascii=False) + ": " + json.dumps({"source": e["src"], "target": e["dst"], "doc_ids": sorted(e["doc_ids"]), "weight": e["weight"]}, ensure_ascii=False))
        f.write("}}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from such an object; edges whose key isn't two names are left out."""
    kinds = "entities map<string, struct<name: string, type: string, doc_ids: array<string>>>, edges map<string, struct<source: string, target: string, doc_ids: array<string>, weight: bigint>>"
    data = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("d"))
    nodes = data.select(F.explode("d.entities").alias("key", "e")).select("key", "e.name", F.coalesce("e.type", F.lit("CONCEPT")).alias("type"), F.coalesce("e.doc_ids", F.array().cast("array<string>")).alias("doc_ids"))
    edges = data.select(F.explode("d.edges").alias("k", "e")).withColumn("ends", F.split("k", r"\|\|")).where("size(ends) = 2")
    return nodes.withColumn("documents", F.size("doc_ids")), edges.select(F.col("ends")[0].alias("src"), F.col("ends")[1].alias("dst"), F.coalesce("e.weight", F.lit(0)).alias("weight"), "e.doc_ids")
