"""Named queries over the test tables, one per operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.columns import citation, condition, content_id, cosine, strip, vector, words
from quillon.operators import embed, evaluate, graph, keyword, prompt, search, split
from quillon.operators.collection import Collection, upserted
from quillon.session import read_table
from quillon.sources import incremental, loaders
from quillon.streaming.watch import fold_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TEXT = "the query planner merges hidden footnotes"


def _shown():
    return F.round("distance", 6).alias("distance")


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


# --- vectors -------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    rows = read_table(spark, sf, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").first()
    return rows, [float(x) for x in first[0]] if first else [0.0]


def _vector_query(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows, q = _vectors(spark, sf)
        return search.ranked(search.top_k(rows, q, 10, None, metric, key="vec_id"), "vec_id").select("rank", "vec_id", "label", _shown())

    return run


_Q = "q as (select embedding::double[] as v from embeddings where vec_id = 0)"
_DIST = {
    "cosine": "1 - list_cosine_similarity(e.embedding::double[], q.v)",
    "l2sq": "list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.v[i]) ** 2))",
    "dot": "-list_inner_product(e.embedding::double[], q.v)",
}
for _m, _d in _DIST.items():
    query(
        f"vec_topk_{_m}",
        f"""with {_Q}, d as (select vec_id, label, round({_d}, 12) + 0.0 as distance from embeddings e, q)
        select row_number() over (order by distance, vec_id) as rank, vec_id, label, round(distance, 6) as distance from d order by distance, vec_id limit 10""",
    )(_vector_query(_m))


@query(
    "vec_topk_filtered",
    f"""with {_Q}, d as (select vec_id, round({_DIST["l2sq"]}, 12) + 0.0 as distance from embeddings e, q where label = 3)
    select row_number() over (order by distance, vec_id) as rank, vec_id, round(distance, 6) as distance from d order by distance, vec_id limit 10""",
)
def vec_topk_filtered(spark, sf):
    rows, q = _vectors(spark, sf)
    return search.ranked(search.top_k(rows, q, 10, F.col("label") == 3, key="vec_id"), "vec_id").select("rank", "vec_id", _shown())


@query(
    "vec_postfilter",
    f"""with {_Q}, d as (select vec_id, label, round({_DIST["l2sq"]}, 12) + 0.0 as distance from embeddings e, q order by distance, vec_id limit 40)
    select vec_id, round(distance, 6) as distance from (select * from d where label = 3 order by distance, vec_id limit 10)""",
)
def vec_postfilter(spark, sf):
    rows, q = _vectors(spark, sf)
    return search.post_filtered(rows, q, 10, F.col("label") == 3, key="vec_id").select("vec_id", _shown())


@query(
    "vec_knn_join",
    """with d as (select a.vec_id as query_id, b.vec_id, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) + 0.0 as distance
      from embeddings a, embeddings b where a.vec_id % 100 = 0)
    select query_id, vec_id, round(distance, 6) as distance, rank from (select query_id, vec_id, distance, row_number() over (partition by query_id order by distance, vec_id) as rank from d) where rank <= 5""",
)
def vec_knn_join(spark, sf):
    """Queries: rows whose id is divisible by 100, against all rows."""
    rows = read_table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn_join(asked, rows, 5, "cosine", key="vec_id").select("query_id", "vec_id", _shown(), "rank")


@query(
    "vec_topk_per_label",
    f"""with {_Q}, d as (select vec_id, label, round({_DIST["l2sq"]}, 12) + 0.0 as distance from embeddings e, q)
    select label, vec_id, round(distance, 6) as distance, rank from (select label, vec_id, distance, row_number() over (partition by label order by distance, vec_id) as rank from d) where rank <= 3""",
)
def vec_topk_per_label(spark, sf):
    rows, q = _vectors(spark, sf)
    return search.top_k_per_group(rows, q, "label", 3, key="vec_id").select("label", "vec_id", _shown(), "rank")


@query(
    "router_merge",
    f"""with {_Q}, d as (select vec_id, label, round({_DIST["l2sq"]}, 12) + 0.0 as distance from embeddings e, q where label in (1, 2, 3)),
    r as (select *, row_number() over (partition by label order by distance, vec_id) as n from d)
    select _collection, vec_id, round(distance, 6) as distance from (select 'label' || label as _collection, vec_id, distance from r where n <= 5 order by distance, _collection, vec_id limit 5)""",
)
def router_merge(spark, sf):
    rows, q = _vectors(spark, sf)
    each = {f"label{i}": search.top_k(rows, q, 5, F.col("label") == i, key="vec_id").select("vec_id", _shown()) for i in (1, 2, 3)}
    return search.merged(each, 5, [*each, "unknown"], "vec_id").select("_collection", "vec_id", _shown())


@query(
    "federated_results",
    """with r as (select distinct query_id, collection, id, distance from query_results where distance is not null and not isnan(distance))
    select * from (select query_id, collection, id, distance, row_number() over (partition by query_id order by distance, collection, id) as rank from r) where rank <= 5""",
)
def federated_results(spark, sf):
    rows = read_table(spark, sf, "query_results").where("distance is not null and not isnan(distance)").select("query_id", "collection", "id", "distance").distinct()
    w = Window.partitionBy("query_id").orderBy("distance", "collection", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


# --- documents: identity, filters, splitting ------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "metadata", "lang", "source", "embedding")


@query("doc_ids", "select doc_id, sha256(text) as content_id, length(text) as chars from documents where text is not null")
def doc_ids(spark, sf):
    return _documents(spark, sf).select("doc_id", content_id("text").alias("content_id"), F.length("text").cast("long").alias("chars"))


@query(
    "dedup_by_content",
    "select content_id, max(doc_id) as doc_id, count(*) as copies from (select sha256(text) as content_id, doc_id from documents where text is not null) group by content_id",
)
def dedup_by_content(spark, sf):
    return _documents(spark, sf).groupBy(content_id("text").alias("content_id")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "where_filters",
    """select doc_id from documents where text is not null and (metadata['team'] is null and try_cast(metadata['path'] as double) is null)
    and (metadata['title'] is not null or source in ('runbooks', 'handbook'))""",
)
def where_filters(spark, sf):
    """A missing key equals None; $or, $in and $ne; a condition on a column of its own."""
    where = {"team": None, "$or": [{"title": {"$ne": None}}, {"source": {"$in": ["runbooks", "handbook"]}}]}
    return _documents(spark, sf).where(condition(where, F.col("metadata"), {"source": F.col("source")})).select("doc_id")


@query(
    "citations",
    """select doc_id, coalesce(metadata['source'], metadata['filename'], substr(sha256(text), 1, 12)) || coalesce('#chunk' || metadata['chunk_index'], '') as citation
    from documents where text is not null""",
)
def citations(spark, sf):
    return _documents(spark, sf).select("doc_id", citation(F.col("metadata"), content_id("text")).alias("citation"))


def _pieces(spark, sf, how, **more):
    rows = how(_documents(spark, sf), **more)
    return rows.select(F.col("source_id").cast("long").alias("doc_id"), "chunk_index", F.length("text").alias("chars"), "id")


# white space that Python's strip, Spark and DuckDB agree on, written out for RE2
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


# position (from 1) of the last newline in the window of 512 characters after st, 0 without one
_LAST = "(select case when contains(x, chr(10)) then length(x) - length(string_split(x, chr(10))[-1]) else 0 end from (select substr(d.text, w.st + 1, 512) as x))"


@query(
    "split_chars",
    f"""with recursive docs as (select doc_id, text, length(text) as n from documents where text is not null and length({_STRIP("text")}) > 0),
    w as (
      select doc_id, 0 as st, 0 as ord from docs where n > 512
      union all
      select doc_id, nx, ord + 1 from (
        select doc_id, ord, n, st + (case when st + 512 < n and p > 64 then p else 512 end) - 64 as nx from (select w.doc_id, w.st, w.ord, d.n, {_LAST} as p from w join docs d using (doc_id)))
      where nx < n),
    pieces as (
      select doc_id, ord, {_STRIP("substr(text, st + 1, case when st + 512 < n and p > 64 then p else 512 end)")} as piece
      from (select w.doc_id, w.st, w.ord, d.n, d.text, {_LAST} as p from w join docs d using (doc_id))
      union all select doc_id, 0, text from docs where n <= 512)
    select doc_id, row_number() over (partition by doc_id order by ord) - 1 as chunk_index, length(piece) as chars, sha256(piece) as id from pieces where piece <> ''""",
)
def split_chars(spark, sf):
    return _pieces(spark, sf, split.split_characters)


@query(
    "split_tokens",
    f"""with docs as (select doc_id, text, string_split_regex({_STRIP("text")}, '{_WS}+') as t from documents where text is not null and length({_STRIP("text")}) > 0),
    w as (select doc_id, text, t, unnest(range(0, 1 + greatest(0, ceil((len(t) - 256) / 224.0)::int))) as i from docs),
    p as (select doc_id, i as chunk_index, case when len(t) <= 256 then text else array_to_string(list_slice(t, i * 224 + 1, i * 224 + 256), ' ') end as piece from w)
    select doc_id, chunk_index, length(piece) as chars, sha256(piece) as id from p""",
)
def split_tokens(spark, sf):
    return _pieces(spark, sf, split.split_tokens)


@query(
    "split_sentences",
    f"""with docs as (select doc_id, list_filter(string_split(regexp_replace({_STRIP("text")}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as s
      from documents where text is not null)
    select doc_id, len(s) as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as longest from docs""",
)
def split_sentences(spark, sf):
    rows = _documents(spark, sf).select("doc_id", split.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query("split_semantic")
def split_semantic(spark, sf):
    return _pieces(spark, sf, split.split_semantic, embed=embed.hashed_vector, threshold=0.1)


@query(
    "hash_embed",
    f"""with w as (select doc_id, unnest(list_filter(string_split_regex({_STRIP("lower(text)")}, '{_WS}+'), lambda x: x <> '')) as w from documents where text is not null),
    c as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as bucket, count(*) as n from w group by 1, 2)
    select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as value from c""",
)
def hash_embed(spark, sf):
    rows = _documents(spark, sf).select("doc_id", F.posexplode(embed.hashed_vector("text")).alias("bucket", "value"))
    return rows.where("value > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


# --- keywords and fusion ------------------------------------------------------------------------------------------------

ENGLISH = "and lang = 'en'"
_TOKENS = f"""tok as (select doc_id, list_filter(string_split_regex({_STRIP("lower(text)")}, '{_WS}+'), lambda x: x <> '') as t from documents where text is not null {{filter}}),
post as (select term, doc_id, count(*) as tf from (select doc_id, unnest(t) as term from tok) group by 1, 2),
df as (select term, count(*) as df from post group by 1),
stats as (select count(*) as documents, avg(len(t)) as avg_length from tok),
idf as (select term, df, ln(documents - df + 0.5) - ln(df + 0.5) as raw, documents, avg_length from df, stats),
vocab as (select count(*) as terms, avg(raw) as mean_idf from idf)"""
_SCORES = f"""{_TOKENS},
asked as (select unnest(string_split('{TEXT}', ' ')) as term),
hits as (
  select p.doc_id, sum((case when i.raw < 0 then 0.25 * v.mean_idf else i.raw end) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(k.t) / i.avg_length))) as s
  from asked a join post p using (term) join idf i using (term) join tok k using (doc_id), vocab v group by 1),
scored as (select k.doc_id, round(coalesce(s, 0), 12) as score from tok k left join hits using (doc_id))"""


@query("bm25_stats", f"with {_TOKENS.replace('{filter}', '')} select documents, round(avg_length, 6) as avg_length, terms, round(mean_idf, 6) as mean_idf from stats, vocab")
def bm25_stats(spark, sf):
    return keyword.statistics(_documents(spark, sf)).select("documents", F.round("avg_length", 6).alias("avg_length"), "terms", F.round("mean_idf", 6).alias("mean_idf"))


def _bm25(spark, sf, where=None):
    rows = _documents(spark, sf)
    scored = keyword.bm25(rows if where is None else rows.where(where), TEXT, "doc_id")
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"with {_SCORES.replace('{filter}', '')} select doc_id, round(score, 6) as score from (select * from scored order by score desc, doc_id limit 20)")
def bm25_topk(spark, sf):
    return _bm25(spark, sf)


@query("bm25_filtered", f"with {_SCORES.replace('{filter}', ENGLISH)} select doc_id, round(score, 6) as score from (select * from scored order by score desc, doc_id limit 20)")
def bm25_filtered(spark, sf):
    return _bm25(spark, sf, F.col("lang") == "en")


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    usable = read_table(spark, sf, "documents").where("text is not null and size(embedding) = 64").orderBy("doc_id").select("embedding").first()
    return [float(x) for x in usable[0]] if usable else [0.0]


def _hybrid(alpha: float) -> Query:
    def run(spark, sf):
        rows = _documents(spark, sf)
        k = 10
        lexical = keyword.ranks(keyword.bm25(rows, TEXT), [F.desc("score"), F.col("id").cast("long")])
        fetch = keyword.vector_fetch(rows.count(), k, alpha)
        near = spark.createDataFrame([], "id string, rank long")
        if fetch:
            near = keyword.ranks(search.top_k(rows, _query_vector(spark, sf), fetch, key="doc_id").select("id", "doc_id", "distance"), [F.col("distance"), F.col("doc_id")], fetch)
        best = keyword.fuse(near, lexical, alpha).withColumn("doc_id", F.col("id").cast("long"))
        return best.orderBy("distance", "doc_id").limit(k).select("doc_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))

    return run


_NEAR = """qv as (select embedding::double[] as v from documents where text is not null and len(embedding) = 64 order by doc_id limit 1),
near as (select doc_id, row_number() over (order by d, doc_id) - 1 as rank from (
  select doc_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - v[i]) ** 2)), 12) as d
  from documents, qv where text is not null and len(embedding) = 64) order by d, doc_id limit {fetch})"""
for _name, _alpha, _fetch in (("hybrid_rrf", 0.5, 20), ("hybrid_rrf_vector", 1.0, 40), ("hybrid_rrf_keyword", 0.0, 0)):
    query(
        _name,
        f"""with {_SCORES.replace("{filter}", "")}, {_NEAR.format(fetch=_fetch)},
        lex as (select doc_id, row_number() over (order by score desc, doc_id) - 1 as rank from scored),
        fused as (select coalesce(n.doc_id, l.doc_id) as doc_id, round(coalesce({_alpha} / (61 + n.rank), 0) + coalesce((1 - {_alpha}) / (61 + l.rank), 0), 9) as s
          from near n full join lex l on n.doc_id = l.doc_id)
        select doc_id, round(s, 6) as score, round(1 - s, 6) as distance from fused order by s desc, doc_id limit 10""",
    )(_hybrid(_alpha))


@query(
    "rerank_lexical",
    f"""with {_NEAR.format(fetch=40)}, d as (
      select doc_id, n.rank, round(len(list_intersect(list_distinct(string_split('{TEXT}', ' ')), string_split_regex({_STRIP("lower(text)")}, '{_WS}+'))) / 6.0, 6) as rerank_score
      from near n join documents using (doc_id))
    select doc_id, rerank_score from d order by rerank_score desc, rank limit 10""",
)
def rerank_lexical(spark, sf):
    top = search.top_k(_documents(spark, sf), _query_vector(spark, sf), 40, key="doc_id")
    return search.reranked(top, TEXT, 10, key="doc_id").select("doc_id", "rerank_score")


@query(
    "parent_best_chunk",
    """with qv as (select embedding::double[] as v from documents where text is not null and len(embedding) = 64 order by doc_id limit 1),
    d as (select doc_id, text, source, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - v[i]) ** 2)), 12) as distance
      from documents, qv where text is not null and len(embedding) = 64),
    top as (select * from d order by distance, doc_id limit 30),
    best as (select * from (select *, row_number() over (partition by source order by distance, doc_id::varchar) as n from top) where n = 1),
    parent as (select collection, max(persist_dir) as persist_dir from index_config group by 1)
    select case when collection is null then doc_id::varchar else collection end as id, round(distance, 6) as distance, case when collection is null then sha256(text) else sha256(persist_dir) end as content
    from best left join parent on collection = source order by distance, id limit 10""",
)
def parent_best_chunk(spark, sf):
    top = search.top_k(_documents(spark, sf), _query_vector(spark, sf), 30, key="doc_id").withColumn("source_id", F.col("source"))
    parents = read_table(spark, sf, "index_config").groupBy(F.col("collection").alias("id")).agg(F.max("persist_dir").alias("text")).withColumn("metadata", F.create_map().cast("map<string,string>"))
    return search.best_parent(top, parents, 10).select("id", _shown(), content_id("text").alias("content"))


# --- graph --------------------------------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in graph.STOP)
# RE2 knows no Unicode word edges: runs of word characters are marked with chr(1) and chr(2) first
_WORDS = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]+"
_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKED = f"regexp_replace(text, '({_WORDS})', chr(1) || '\\1' || chr(2), 'g')"
_MENTIONS = f"""men as (
  select doc_id, i, e as name, lower(e) as key from (
    select doc_id, translate(unnest(es), chr(1) || chr(2), '') as e, generate_subscripts(es, 1) as i from (
      select doc_id, regexp_extract_all({_MARKED}, '\\x01[A-Z][a-z]+\\x02(?:{_SPACE}+\\x01[A-Z][a-z]+\\x02)*') as es from documents where text is not null))
  where length(e) >= 2 and e not in ({_STOPS}))"""


def _mentions(spark, sf):
    return graph.entity_mentions(_documents(spark, sf))


@query("entities_extracted", f"with {_MENTIONS} select doc_id, count(*) as mentions, count(distinct key) as keys from men group by 1")
def entities_extracted(spark, sf):
    return _mentions(spark, sf).groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.count("*").alias("mentions"), F.countDistinct("key").alias("keys"))


@query(
    "entity_nodes",
    f"with {_MENTIONS} select key, arg_min(name, (doc_id::varchar, i)) as name, count(distinct doc_id) as documents from men group by key",
)
def entity_nodes(spark, sf):
    return graph.graph_nodes(_mentions(spark, sf)).select("key", "name", "documents")


@query(
    "entity_edges",
    f"with {_MENTIONS}, own as (select distinct doc_id, key from men) select a.key as src, b.key as dst, count(*) as weight from own a join own b on a.doc_id = b.doc_id and a.key < b.key group by 1, 2",
)
def entity_edges(spark, sf):
    return graph.graph_edges(_mentions(spark, sf), doc_ids=False)


@query(
    "graph_nodes_listed",
    """select lower(name) as key, max(upper(entity_type)) as type, count(distinct d) as documents from (
      select name, entity_type, unnest(case when len(doc_ids) > 0 then doc_ids else [null] end) as d from entities) where name is not null group by 1""",
)
def graph_nodes_listed(spark, sf):
    return graph.listed_nodes(read_table(spark, sf, "entities")).select("key", "type", "documents")


_EDGES = """edges as (select src, dst, count(*) as weight from (
  select distinct least(lower(source), lower(target)) as src, greatest(lower(source), lower(target)) as dst, d from (
    select source, target, unnest(doc_ids) as d from relationships)) where src <> dst group by 1, 2)"""


@query("graph_edges_listed", f"with {_EDGES} select src, dst, weight from edges")
def graph_edges_listed(spark, sf):
    return graph.listed_edges(read_table(spark, sf, "relationships"))


_BOTH = "both_ways as (select src as a, dst as b from edges union all select dst, src from edges)"
_START = "start as (select min(src) as key from edges)"
_HOPS = """hops as (
  select b as key, 1 as hop from both_ways join start on a = key
  union select y.b, 2 from both_ways x join start on x.a = start.key join both_ways y on y.a = x.b),
near as (select key, min(hop) as hop from hops where key <> (select key from start) group by key)"""


def _start(edges: DataFrame) -> str:
    return edges.agg(F.min("src")).first()[0] or ""


@query("graph_neighbours", f"with {_EDGES}, {_BOTH}, {_START}, {_HOPS} select key, hop from near")
def graph_neighbours(spark, sf):
    edges = graph.listed_edges(read_table(spark, sf, "relationships"))
    return graph.neighbours(edges, _start(edges), 2)


def _listed_mentions(spark, sf):
    return read_table(spark, sf, "entities").where("name is not null").select(F.lower("name").alias("key"), F.explode("doc_ids").alias("id")).where("id is not null").distinct()


_RELATED = "rel as (select d as id, min(hop) as hop from (select lower(name) as key, unnest(doc_ids) as d from entities) m join (select key, hop from near union all select key, 0 from start) using (key) where d is not null group by 1)"


@query("graph_related_docs", f"with {_EDGES}, {_BOTH}, {_START}, {_HOPS}, {_RELATED} select id, hop from rel")
def graph_related_docs(spark, sf):
    edges = graph.listed_edges(read_table(spark, sf, "relationships"))
    return graph.related_documents(_listed_mentions(spark, sf), edges, _start(edges), 2)


@query(
    "graph_rrf",
    f"""with {_EDGES}, {_BOTH}, {_START}, {_HOPS}, {_RELATED},
    docs as (select id, min(doc_id) as doc_id from documents where text is not null group by 1),
    g as (select id, row_number() over (order by hop, id) - 1 as rank from rel),
    qv as (select embedding::double[] as v from documents where text is not null and len(embedding) = 64 order by doc_id limit 1),
    n as (select id, row_number() over (order by d, id) - 1 as rank from (
      select id, min(round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - v[i]) ** 2)), 6)) as d
      from documents, qv where text is not null and len(embedding) = 64 group by id) order by d, id limit 20),
    f as (select coalesce(g.id, n.id) as id, round(coalesce(0.5 / (60 + g.rank), 0) + coalesce(0.5 / (60 + n.rank), 0), 9) as s from g full join n on g.id = n.id)
    select id, doc_id, round(1 - s, 6) as distance from f join docs using (id) order by s desc, id limit 10""",
)
def graph_rrf(spark, sf):
    edges = graph.listed_edges(read_table(spark, sf, "relationships"))
    related = graph.related_documents(_listed_mentions(spark, sf), edges, _start(edges), 2)
    ranking = keyword.ranks(related, [F.col("hop"), F.col("id")])
    rows = read_table(spark, sf, "documents").where("text is not null")
    scored = rows.withColumn("distance", F.round(search.distance(F.col("embedding"), vector(_query_vector(spark, sf)), "l2sq"), search.DIGITS)).where("distance is not null")
    near = keyword.ranks(scored.groupBy("id").agg(F.min("distance").alias("distance")), [F.col("distance"), F.col("id")], 20)
    known = rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")).withColumn("metadata", F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")))
    best = graph.graph_fusion(ranking, near, known, 10)
    return best.select("id", F.col("metadata")["doc_id"].cast("long").alias("doc_id"), F.round("distance", 6).alias("distance"))


# --- evaluation and prompts -----------------------------------------------------------------------------------------------

_EVAL = """base as (select distinct query_id, collection, id, distance, rerank_score from query_results
  where distance is not null and rerank_score is not null and not isnan(distance) and not isnan(rerank_score)),
best as (select query_id, id, min(distance) as distance, max(rerank_score) as score from base group by 1, 2),
ranked as (select query_id, id, row_number() over (partition by query_id order by distance, id) as rank, row_number() over (partition by query_id order by score desc, id) as place from best),
shown as (select query_id, rank, place <= 3 as hit from ranked where rank <= 10),
need as (select query_id, count(*) as wanted from ranked where place <= 3 group by 1),
per as (select query_id, min(case when hit then rank end) as first, sum(case when hit then 1 / log2(rank + 1) else 0 end) as dcg, sum(hit::int) as hits from shown group by 1),
rows as (select query_id, round(coalesce(1.0 / first, 0), 6) as reciprocal_rank, round(coalesce(dcg, 0), 6) as dcg,
  round(coalesce(dcg / (case when hits > 0 then list_sum(list_transform(range(1, hits::int + 1), lambda i: 1 / log2(i + 1))) end), 0), 6) as ndcg,
  round(coalesce(hits / wanted::double, 0), 6) as recall from per join need using (query_id))"""


def _evaluated(spark, sf):
    """Results in order of distance, judged by the three best rerank scores of each query."""
    rows = read_table(spark, sf, "query_results").where("distance is not null and rerank_score is not null and not isnan(distance) and not isnan(rerank_score)")
    best = rows.groupBy("query_id", "id").agg(F.min("distance").alias("distance"), F.max("rerank_score").alias("score"))
    w = Window.partitionBy("query_id")
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy("distance", "id"))).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    return evaluate.evaluate(ranked.where("rank <= 10"), ranked.where("place <= 3"))


@query("eval_per_query", f"with {_EVAL} select * from rows")
def eval_per_query(spark, sf):
    return _evaluated(spark, sf)


@query("eval_summary", f"with {_EVAL} select count(*) as queries, round(avg(reciprocal_rank), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall from rows")
def eval_summary(spark, sf):
    return evaluate.summary(_evaluated(spark, sf))


@query(
    "prompt_format",
    """with top as (select doc_id, text, metadata, row_number() over (order by doc_id) as rank from documents where text is not null order by doc_id limit 5),
    p as (select rank, '[' || rank || '] ' || text || chr(10) || '(source: ' || c || ')' || chr(10) as chunk, '[' || rank || '] ' || c as source from (
      select *, coalesce(metadata['source'], metadata['filename'], substr(doc_id::varchar, 1, 12)) as c from top))
    select string_agg(chunk, chr(10) order by rank) as context, string_agg(source, chr(10) order by rank) as sources from p""",
)
def prompt_format(spark, sf):
    top = _documents(spark, sf).orderBy("doc_id").limit(5)
    return prompt.assembled(top.withColumn("rank", F.row_number().over(Window.orderBy("doc_id"))))


# --- ingest and change --------------------------------------------------------------------------------------------------


@query("html_text")
def html_text(spark, sf):
    """Every text that isn't null; one without tags comes out stripped, with its character references read."""

    @F.pandas_udf("string")
    def visible(texts):
        return texts.map(loaders.visible_text)

    return _documents(spark, sf).select("doc_id", visible("text").alias("text"))


@query("front_matter")
def front_matter(spark, sf):
    @F.pandas_udf("struct<body: string, metadata: map<string, string>>")
    def parse(texts):
        import pandas as pd

        return pd.DataFrame([loaders.front_matter(t) for t in texts], columns=["body", "metadata"])

    return _documents(spark, sf).where("startswith(text, '---')").select("doc_id", parse("text").alias("p")).select("doc_id", "p.body", "p.metadata")


_STORED = "select doc_id::varchar as path, case when doc_id % 7 = 1 then sha256(text || '!') else sha256(text) end as old from documents where text is not null and doc_id % 7 <> 0 union all select 'gone-' || doc_id, 'x' from documents where text is not null and doc_id % 7 = 2"


def _fingerprints(spark, sf):
    rows = _documents(spark, sf)
    now = rows.select(F.col("id").alias("path"), content_id("text").alias("sha256"))
    old = rows.where("doc_id % 7 <> 0").select(F.col("id").alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 1, "!").otherwise("")), 256).alias("sha256"))
    gone = rows.where("doc_id % 7 = 2").select(F.concat(F.lit("gone-"), "id").alias("path"), F.lit("x").alias("sha256"))
    return now, old.unionByName(gone)


@query(
    "fingerprint_diff",
    f"""with now as (select doc_id::varchar as path, sha256(text) as new from documents where text is not null), stored as ({_STORED})
    select coalesce(now.path, stored.path) as path, new as sha256, case when old is null then 'new' when new is null then 'deleted' when old = new then 'unchanged' else 'changed' end as state
    from now full join stored on now.path = stored.path""",
)
def fingerprint_diff(spark, sf):
    """The stored side lacks a seventh of all documents, differs in another one, and has paths that are gone."""
    return incremental.difference(*_fingerprints(spark, sf))


@query(
    "fingerprint_update",
    "select doc_id::varchar as path, sha256(text) as sha256 from documents where text is not null",
)
def fingerprint_update(spark, sf):
    now, old = _fingerprints(spark, sf)
    return incremental.updated(old, incremental.difference(now, old))


@query(
    "upsert",
    """with incoming as (select id, text, doc_id from documents where text is not null and lang = 'en'),
    last as (select id, max_by(text, doc_id) as text, max(doc_id) as doc_id from incoming group by id),
    held as (select id, max_by(text, doc_id) as text, max(doc_id) as doc_id from documents where text is not null and (lang <> 'en' or lang is null) group by id)
    select id, doc_id, sha256(text) as content from last union all select id, doc_id, sha256(text) from held where id not in (select id from last)""",
)
def upsert(spark, sf):
    """English documents are put over all others; the largest doc_id of an id stays."""
    rows = read_table(spark, sf, "documents").where("text is not null").select("id", "text", "doc_id", "lang")
    last = lambda df: df.groupBy("id").agg(F.max_by("text", "doc_id").alias("text"), F.max("doc_id").alias("doc_id"))
    out = upserted(last(rows.where("lang <> 'en' or lang is null")), last(rows.where("lang = 'en'")))
    return out.select("id", "doc_id", content_id("text").alias("content"))


@query("delete_by_source", "select doc_id, source from documents where text is not null and source not in ('helpdesk', 'runbooks')")
def delete_by_source(spark, sf):
    rows = _documents(spark, sf)
    gone = spark.createDataFrame([("helpdesk",), ("runbooks",)], "source string")
    return rows.join(F.broadcast(gone), "source", "left_anti").select("doc_id", "source")


@query("change_fold", "select user_id::varchar as path, arg_max(event_type, event_id) as op from events group by 1")
def change_fold(spark, sf):
    return fold_changes(read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("seq")))


@query(
    "collection_roundtrip",
    f"select count(*) as n, count(distinct id) as ids from (select max(doc_id), sha256(text) as id from documents where text is not null and length({_STRIP('text')}) > 0 group by 2)",
)
def collection_roundtrip(spark, sf):
    """Write a collection, write half of it again, read it."""
    import uuid

    from quillon.session import shared_dir

    rows = _documents(spark, sf).where(F.length(strip("text")) > 0).select(content_id("text").alias("id"), "text", "metadata", "embedding")
    c = Collection(spark, shared_dir(spark), f"trip-{uuid.uuid4().hex}")
    c.upsert(rows)
    c.upsert(rows.where("pmod(xxhash64(id), 2) = 0"))
    return c.rows().agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("jsonl_roundtrip", "select doc_id::varchar as id, sha256(text) as content, coalesce(metadata['title'], '') as title from documents where text is not null and text <> ''")
def jsonl_roundtrip(spark, sf):
    path = _scratch(spark, "lines")
    loaders.export_jsonl(_documents(spark, sf), path)
    return loaders.import_jsonl(spark, path).select("id", content_id("text").alias("content"), F.coalesce(F.col("metadata")["title"], F.lit("")).alias("title"))


@query(
    "where_operators",
    """select doc_id from documents where text is not null and n_chars >= 100 and n_chars < 5000 and coalesce(source, '') not in ('helpdesk', 'runbooks') and doc_id > 10 and (lang = 'en' or doc_id <= 500)""",
)
def where_operators(spark, sf):
    rows = read_table(spark, sf, "documents").where("text is not null")
    where = {"$and": [{"n_chars": {"$gte": 100, "$lt": 5000}}, {"source": {"$nin": ["helpdesk", "runbooks"]}}, {"doc_id": {"$gt": 10}}, {"$or": [{"lang": {"$eq": "en"}}, {"doc_id": {"$lte": 500}}]}]}
    return rows.where(condition(where, F.col("metadata"), {c: F.col(c) for c in ("n_chars", "source", "doc_id", "lang")})).select("doc_id")


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from quillon.session import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_NO_BLANKS = f"text is not null and length({_STRIP('text')}) > 0"


def _filled(spark, sf) -> Collection:
    """English documents put over all others, a batch each; of an id the largest doc_id arrives last."""
    rows = read_table(spark, sf, "documents").where(F.length(strip("text")) > 0)
    rows = rows.select("id", "text", F.create_map(F.lit("source"), F.coalesce("source", F.lit("none"))).alias("metadata"), "embedding", "lang", "doc_id")
    c = Collection(spark, _scratch(spark, "collections"), "c")
    c.upsert(rows.where("lang <> 'en' or lang is null"), "doc_id")
    c.upsert(rows.where("lang = 'en'"), "doc_id")
    return c


_FILLED = f"""base as (select id, text, lang, doc_id, coalesce(source, 'none') as source from documents where {_NO_BLANKS}),
filled as (select * from (select *, row_number() over (partition by id order by coalesce(lang = 'en', false) desc, doc_id desc) as n from base) where n = 1)"""


@query("collection_upsert", f"with {_FILLED} select id, sha256(text) as content, source from filled")
def collection_upsert(spark, sf):
    return _filled(spark, sf).rows().select("id", content_id("text").alias("content"), F.col("metadata")["source"].alias("source"))


@query("collection_delete", f"with {_FILLED} select id from filled where source not in ('helpdesk', 'runbooks') and id not in (select max(id) from filled)")
def collection_delete(spark, sf):
    c = _filled(spark, sf)
    c.delete([c.rows().agg(F.max("id")).first()[0] or ""])
    c.delete_sources(["helpdesk", "runbooks"])
    return c.all().select("id")


@query("collection_by_ids", f"with {_FILLED} select id, sha256(text) as content from filled where id in ((select max(id) from filled), (select min(id) from filled))")
def collection_by_ids(spark, sf):
    c = _filled(spark, sf)
    low, high = c.rows().agg(F.min("id"), F.max("id")).first()
    return c.by_ids([high, "unknown", low, high]).select("id", content_id("text").alias("content"))


def _index(spark, sf):
    from quillon.engine import Index

    index = Index(spark, _scratch(spark, "index"), "documents")
    index.add(_documents(spark, sf).where(F.length(strip("text")) > 0).select("id", "text", F.create_map(F.lit("source"), F.coalesce("source", F.lit("none"))).alias("metadata")))
    return index


_HASHED = f"""w as (select doc_id, unnest(list_filter(string_split_regex({_STRIP("lower(text)")}, '{_WS}+'), lambda x: x <> '')) as w from documents where {_NO_BLANKS}),
c as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as bucket, count(*) as n from w group by 1, 2),
v as (select doc_id, bucket, (n / sqrt(sum(n * n) over (partition by doc_id)))::float::double as x from c),
qc as (select ('0x' || substr(md5(w), 1, 8))::bigint % 64 as bucket, count(*) as n from (select unnest(string_split('{TEXT}', ' ')) as w) group by 1),
qx as (select bucket, n / sqrt(sum(n * n) over ()) as y from qc),
dist as (select doc_id, round(sum(x * x) + 1 - 2 * sum(x * coalesce(y, 0)), 12) as d from v left join qx using (bucket) group by doc_id)"""


@query(
    "index_query",
    f"with {_HASHED} select row_number() over (order by d, doc_id::varchar) as rank, doc_id::varchar as id, round(d, 4) as distance from dist order by d, doc_id::varchar limit 10",
)
def index_query(spark, sf):
    return _index(spark, sf).query(TEXT, 10).select("rank", "id", F.round("distance", 4).alias("distance"))


@query(
    "index_keyword_query",
    f"""with {_SCORES.replace("where text is not null {filter}", "where " + _NO_BLANKS)}
    select row_number() over (order by score desc, doc_id::varchar) as rank, doc_id::varchar as id from scored order by score desc, doc_id::varchar limit 10""",
)
def index_keyword_query(spark, sf):
    """Through the keyword index of the snapshot; alpha 0 leaves the keyword ranking alone."""
    index = _index(spark, sf)
    index.hybrid_query(TEXT, 10, alpha=0.0).collect()
    return index.hybrid_query(TEXT, 10, alpha=0.0).select("rank", "id")


@query("router_query")
def router_query(spark, sf):
    from quillon.engine import Router

    index = _index(spark, sf)
    return Router({"a": index, "b": index}).query(TEXT, 10, ["a", "b", "unknown"]).select("_collection", "id", F.round("distance", 4).alias("distance"))


@query("index_graph_query")
def index_graph_query(spark, sf):
    index = _index(spark, sf)
    kg = graph.KnowledgeGraph(spark)
    kg.add(index.collection.all().select("id", "text"))
    return index.graph_query("Harbour Query", kg.mentions, graph.graph_edges(kg.mentions, doc_ids=False), 10).select("rank", "id")


def _nation_files(spark, sf) -> str:
    """A text file per nation in a folder of its own."""
    path = _scratch(spark, "nations")
    read_table(spark, sf, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    return path


@query("load_directory", "select sha256(n_name || chr(10)) as id, n_name as name, '.txt' as extension from nation")
def load_directory(spark, sf):
    rows = loaders.load_directory(spark, _nation_files(spark, sf), "**/*.txt")
    return rows.select("id", strip("text").alias("name"), F.col("metadata")["extension"].alias("extension"))


@query("sync_directory", "select 'first' as run, 'new' as state, count(*) as files from nation union all select 'second', 'unchanged', count(*) from nation union all select 'held', 'rows', count(*) from nation")
def sync_directory(spark, sf):
    """A folder twice: all is new, then all is unchanged, and each file is held once."""
    path, c = _nation_files(spark, sf), Collection(spark, _scratch(spark, "collections"), "s")
    embedded = lambda rows: embed.embedded(rows, embed.HashingBackend())
    runs = [incremental.sync_directory(spark, path, c, embedded) for _ in range(2)]
    rows = [(run, state, n) for run, counts in zip(("first", "second"), runs) for state, n in counts.items()]
    return spark.createDataFrame([*rows, ("held", "rows", c.count())], "run string, state string, files long")


@query("service_replies", "select t as call, count(*) as documents from nation, (values ('stats'), ('collection_info')) as calls(t) group by t")
def service_replies(spark, sf):
    import json

    from quillon.engine import Index
    from quillon.service import mcp
    from quillon.service.http import Routes

    index = Index(spark, _scratch(spark, "index"), "nations")
    index.add(read_table(spark, sf, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("text"), F.lit(None).cast("map<string,string>").alias("metadata")))
    told = mcp.answer(index, json.dumps({"id": 1, "method": "tools/call", "params": {"name": "collection_info"}}))["result"]["content"][0]["text"]
    return spark.createDataFrame([("stats", Routes(index).stats({})["documents"]), ("collection_info", json.loads(told)["documents"])], "call string, documents long")


@query(
    "consecutive_similarity",
    f"""with s as (select doc_id, s, i from (select doc_id, unnest(s) as s, generate_subscripts(s, 1) as i from (
        select doc_id, list_filter(string_split(regexp_replace({_STRIP("text")}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as s from documents where text is not null))),
    w as (select doc_id, i, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as b, count(*) as n from (
        select doc_id, i, unnest(list_filter(string_split_regex({_STRIP("lower(s)")}, '{_WS}+'), lambda x: x <> '')) as w from s) group by 1, 2, 3),
    z as (select doc_id, i, sqrt(sum(n * n)) as z from w group by 1, 2),
    d as (select a.doc_id, a.i, sum(a.n * b.n) as d from w a join w b on a.doc_id = b.doc_id and a.i = b.i + 1 and a.b = b.b group by 1, 2)
    select x.doc_id, count(*) as pairs, round(avg(coalesce(d, 0) / (x.z * y.z)), 4) as mean from z x join z y on x.doc_id = y.doc_id and x.i = y.i + 1
    left join d on d.doc_id = x.doc_id and d.i = x.i group by 1""",
)
def consecutive_similarity(spark, sf):
    """Cosine of each sentence and the one before it."""
    rows = _documents(spark, sf).select("doc_id", F.posexplode(split.sentences("text")).alias("pos", "s")).withColumn("v", embed.hashed_vector("s"))
    before = F.lag("v").over(Window.partitionBy("doc_id").orderBy("pos"))
    pairs = rows.withColumn("c", F.when(before.isNotNull(), cosine(before, F.col("v")))).where("c is not null")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.round(F.avg("c"), 4).alias("mean"))
