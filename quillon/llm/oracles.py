"""SQL that gives the same rows, for the queries that SQL can express on whole tables."""

_RESULTS = """
rows as (
  select distinct query_id, collection, id, distance + 0.0 as distance, rerank_score + 0.0 as rerank_score from query_results
  where distance is not null and rerank_score is not null and not isnan(distance) and not isnan(rerank_score)),
placed as (
  select *, rank() over (partition by query_id, collection order by distance) as place_distance,
    rank() over (partition by query_id order by rerank_score desc) as place_rerank_score,
    count(*) over (partition by query_id, collection, distance) as peers_d, count(*) over (partition by query_id, collection) as n_d,
    count(*) over (partition by query_id, rerank_score) as peers_r, count(*) over (partition by query_id) as n
  from rows)
"""
_SETTINGS = """
conf as (
  select collection, case when chunk_size >= 1 then chunk_size else 512 end as size from (
    select *, row_number() over (partition by collection order by updated_at desc nulls last, config_id desc) as n from index_config) where n = 1)
"""
_PAIRS = """
mentions as (
  select distinct lower(name) as name, doc from (select name, unnest(doc_ids) as doc from entities where name is not null) where doc is not null),
sizes as (select name, count(*) as n from mentions group by name),
total as (select count(distinct doc) as n_docs from mentions),
pairs as (
  select a.name as source, b.name as target, count(*) as n_ab from mentions a join mentions b on a.doc = b.doc and a.name < b.name group by 1, 2),
scored as (
  select source, target, n_ab, x.n as n_a, y.n as n_b, n_docs from pairs join sizes x on x.name = source join sizes y on y.name = target, total)
"""

_CANON = "lower(regexp_replace(upper({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_FIELD = "^\\s*[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M} _./-]*\\s*:"
_PARTS = lambda sep: f"list_filter(string_split_regex(text, '{sep}'), lambda x: trim(x) <> '')"
_OPTIONS = " ".join(f"when len({p}) >= 3 and len(list_filter({p}, lambda x: not regexp_matches(x, '{_FIELD}'))) = 0 then {p}" for p in map(_PARTS, ("\\r?\\n", ";", "\\|", ",", "[\\r\\n;|]", "[\\r\\n;|,]")))
_ENTRIES = "list_transform(json_keys(text), lambda k: k || ': ' || coalesce(json_extract_string(text, '/' || replace(replace(k, '~', '~0'), '/', '~1')), 'null'))"
_NESTED = "len(list_filter(json_keys(text), lambda k: json_type(text, '/' || replace(replace(k, '~', '~0'), '/', '~1')) in ('OBJECT', 'ARRAY')))"
_STEP = "l{b} as (select doc_id, min(m) as l from (select k.doc_id, min(l) over (partition by k.key) as m from keys k join l{a} using (doc_id)) group by 1)"
# documents linked by a shared key, labels spread to the smallest doc_id in six steps
_RECORDS = f"""
docs as (select doc_id, text, {_CANON.format("text")} as c from documents where text is not null),
split as (select doc_id, case when regexp_matches(text, '^\\s*\\{{') then case when json_valid(text) and len(json_keys(text)) >= 3 and {_NESTED} = 0 then {_ENTRIES} end
  when regexp_matches(text, '{_FIELD}') then case {_OPTIONS} end end as fields from docs where c <> ''),
keys as (
  select doc_id, 'w' || c as key from docs where c <> ''
  union all select doc_id, 'f' || array_to_string(list_sort(list_transform(fields, lambda x: {_CANON.format("x")})), '|') from split where fields is not null),
l0 as (select distinct doc_id, doc_id as l from keys), {", ".join(_STEP.format(a=i, b=i + 1) for i in range(6))}
"""
_SHINGLES = """
words as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
runs as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) as r from words where len(w) >= 3),
sizes as (select doc_id, count(*) as n from runs group by 1),
shared as (select a.doc_id as doc_id_a, b.doc_id as doc_id_b, count(*) as c from runs a join runs b on a.r = b.r and a.doc_id < b.doc_id group by 1, 2)
"""
_COSINES = """
usable as (select doc_id, embedding::double[] as v from documents where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
ranked as (select a.doc_id, b.doc_id as neighbour_id, list_cosine_similarity(a.v, b.v) as cosine,
    row_number() over (partition by a.doc_id order by round(list_cosine_similarity(a.v, b.v), 10) desc, b.doc_id) as rank
  from usable a join usable b on a.doc_id <> b.doc_id {where})
"""

SQL: dict[str, str] = {
    "p1_found": f"with {_RESULTS} select distinct query_id, id from placed where place_distance <= 3 and place_rerank_score <= 3",
    "p1_ranking": f"""with {_RESULTS},
      scaled as (select *, (place_distance - 1 + peers_d / 2.0) / n_d as xd, (place_rerank_score - 1 + peers_r / 2.0) / n as xr from placed),
      flows as (
        select a.query_id, a.collection, a.id, a.distance, a.rerank_score, a.place_distance, a.place_rerank_score, a.n,
          sum(greatest(0, least(1, (b.xd - a.xd - 0.05) / 0.45)) - greatest(0, least(1, (a.xd - b.xd - 0.05) / 0.45))) as fd,
          sum(greatest(0, least(1, (b.xr - a.xr - 0.05) / 0.45)) - greatest(0, least(1, (a.xr - b.xr - 0.05) / 0.45))) as fr
        from scaled a join scaled b on a.query_id is not distinct from b.query_id group by all)
      select query_id, collection, id, place_distance, place_rerank_score,
        round(round(case when n > 1 then (0.5 * fd + 0.5 * fr) / (n - 1) else 0 end, 9), 6) + 0.0 as net_flow from flows""",
    "p3_found": f"with {_SETTINGS} select doc_id from documents left join conf on source = collection where length(text) > coalesce(size, 512)",
    "p4_found": f"with {_PAIRS} select source, target from scored where n_ab >= 5 and n_ab * n_docs >= 5 * n_a * n_b",
    "p4_pairs": f"with {_PAIRS} select source, target, n_ab, n_a, n_b, round(n_ab * n_docs / (n_a::double * n_b), 6) as lift from scored",
    "p2_found": f"with {_RECORDS} select distinct l as keep_id, doc_id from l6 where l <> doc_id",
    "p2_records": f"with {_RECORDS} select l as keep_id, count(*) as copies from l6 group by l",
    "p5_found": f"with {_SHINGLES} select doc_id_a, doc_id_b from shared join sizes x on x.doc_id = doc_id_a join sizes y on y.doc_id = doc_id_b where c >= 0.6 * (x.n + y.n - c)",
    "p7_found": f"with {_COSINES.format(where='')} select distinct least(doc_id, neighbour_id) as doc_id_a, greatest(doc_id, neighbour_id) as doc_id_b from ranked where rank <= 5 and cosine >= 0.9",
    "p7_nearest": f"with {_COSINES.format(where='where a.doc_id % 100 = 0')} select doc_id, neighbour_id, round(cosine, 6) as cosine, rank from ranked where rank <= 5",
}
