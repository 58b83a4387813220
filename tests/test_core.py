"""Operators against values worked out by hand."""

import json
import os
import random
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.config import load_settings
from quillon.engine import Index, Pipeline, Router, Store, document
from quillon.functions.columns import condition, cosine, vector
from quillon.operators import evaluate, graph, keyword, prompt, search, split
from quillon.operators.collection import Collection, collection_names
from quillon.operators.embed import EmbeddingBackend, EmbeddingCache, HashingBackend, OpenAIBackend, hashed_vector
from quillon.service import mcp
from quillon.service.http import Routes, make_server
from quillon.sources import incremental, loaders
from quillon.streaming.watch import change_stream, fold_changes
from quillon.timing import reset_timings, timed, timings


def docs(spark, rows):
    return spark.createDataFrame([(i, t, m) for i, t, m in rows], "id string, text string, metadata map<string,string>")


def test_character_windows():
    w = split.character_windows
    assert w("Short text", 100, 10) == ["Short text"]
    assert w("one two three four five six seven eight", 20, 5, " ") == ["one two three four", "four five six seven", "even eight"]
    assert w("abcdefghijklmnop", 10, 3, "") == ["abcdefghij", "hijklmnop", "op"]
    assert w("abcdefghijklmnop", 10, 3, "", drop_tail=True) == ["abcdefghij", "hijklmnop"]
    assert [len(p) for p in w("A" * 50, 20, 5)] == [20, 20, 20, 5]
    assert w("", 5, 1) == []


@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.data())
def test_character_windows_end_and_fit(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    pieces = split.character_windows(text, size, overlap)
    assert all(len(p) <= max(size, 0) for p in pieces) or len(text) <= size
    assert set("".join(pieces).replace("\n", "").replace(" ", "")) == set(text.replace("\n", "").replace(" ", ""))


def test_long_line_after_a_cut_ends():
    # windows [0, 101), [37, 549), [485, 997), [933, 1101)
    assert [len(p) for p in split.character_windows("x" * 100 + "\n" + "y" * 1000, 512, 64)] == [100, 512, 512, 168]


def test_longer_separators():
    w = split.character_windows
    assert w("one||two||three||four||five", 12, 2, "||") == ["one||two||", "||three||", "||four||five", "ve"]
    assert w("aaa||bbb", 6, 1, "||") == ["aaa||", "|bbb"]
    assert w("ab|" * 10, 9, 0, "|") == ["ab|ab|ab|"] * 3 + ["ab|"]


def test_front_matter():
    f = loaders.front_matter
    assert f("---\ntitle: 'A: b'\nempty:\n: none\nplain\n---\n\nBody --- more\n") == ("Body --- more", {"title": "A: b"})
    assert f("---\nno end") == ("---\nno end", {}) and f(" text ") == ("text", {}) and f("------x") == ("x", {})


def test_splitters(spark):
    d = docs(spark, [("d", "a b c d e f g h", {"k": "v"}), ("e", " ", None), ("f", None, None)])
    rows = split.split_tokens(d, 3, 1).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["a b c", "c d e", "e f g", "g h"]
    assert rows[0].metadata == {"k": "v", "chunk_index": "0", "source_id": "d", "split_method": "tokens"}
    assert split.split_characters(docs(spark, [("d", "A" * 50, None)]), 20, 5).select("id").distinct().count() == 2
    with pytest.raises(ValueError):
        split.split_characters(d, 5, 5)


def test_semantic(spark):
    vectors = {"A one.": [1.0, 0.0], "B two.": [0.9, 0.1], "C three.": [0.0, 1.0]}
    fixed = lambda c: F.coalesce(*[F.when(c == k, vector(v)) for k, v in vectors.items()])
    d = docs(spark, [("d", "A one. B two. C three.", None)])
    assert [r.text for r in split.split_semantic(d, fixed, 0.8, min_size=1).orderBy("chunk_index").collect()] == ["A one. B two.", "C three."]
    same = lambda c: vector([1.0, 0.0])
    long = docs(spark, [("d", " ".join("x" * 29 + "." for _ in range(5)), None)])
    assert [len(r.text) for r in split.split_semantic(long, same, 0.5, 50, 1).orderBy("chunk_index").collect()] == [50, 50, 50, 4]
    apart = lambda c: F.when(c == "A.", vector([1.0, 0.0, 0.0])).when(c == "B.", vector([0.0, 1.0, 0.0])).otherwise(vector([0.0, 0.0, 1.0]))
    assert [r.text for r in split.split_semantic(docs(spark, [("d", "A. B. C.", None)]), apart, 0.9, 2048, 200).collect()] == ["A. B. C."]


def test_cosine(spark):
    row = spark.range(1).select(cosine(vector([1, 0]), vector([1, 0])).alias("a"), cosine(vector([1, 0]), vector([0, 1])).alias("b"), cosine(vector([0, 0]), vector([0, 1])).alias("c")).first()
    assert tuple(row) == (1.0, 0.0, 0.0)


def test_hashing_backend_equals_column(spark):
    text = "The cat the CAT  sat down"
    assert spark.createDataFrame([(text,)], "t string").select(hashed_vector("t", 16)).first()[0] == pytest.approx(HashingBackend(16).encode([text.replace(" ", " ")])[0])
    assert isinstance(HashingBackend(), EmbeddingBackend)
    with pytest.raises(ValueError):
        HashingBackend().encode_batched(["a"], 0)


def test_where(spark):
    d = spark.createDataFrame([(1, {"a": "5", "b": "x"}), (2, {"a": "10"}), (3, {})], "i int, metadata map<string,string>")
    found = lambda w: sorted(r.i for r in d.where(condition(w, F.col("metadata"))).collect())
    assert found({"a": 5}) == [1] and found({"b": None}) == [2, 3] and found({"a": {"$gt": 7}}) == [2]
    assert found({"$or": [{"a": "5"}, {"a": {"$in": [None]}}]}) == [1, 3] and found({"a": {"$nin": ["5"]}}) == [2, 3] and found({}) == [1, 2, 3]
    assert found({"a": {"$ne": "5"}}) == [2, 3] and found({"$and": [{"a": {"$lte": 5}}, {"b": "x"}]}) == [1]
    with pytest.raises(ValueError):
        found({"a": {"$like": "x"}})


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    assert c.count() == 0 and c.search([1.0], 3).collect() == []
    kinds = "id string, text string, metadata map<string,string>, embedding array<float>"
    rows = spark.createDataFrame([("a", "A", {"source": "f", "t": "g"}, [1.0, 0.0]), ("b", "B", {"t": "p"}, [0.0, 1.0]), ("c", "C", None, [0.5, 0.5])], kinds)
    c.upsert(rows)
    assert [(r.id, r.distance) for r in c.search([1.0, 0.0], 2).collect()] == [("a", 0.0), ("c", 0.5)]
    assert [(r.id, r.distance) for r in c.search([0.5, 0.5], 1, {"t": "p"}).collect()] == [("b", 0.5)]
    c.upsert(spark.createDataFrame([("a", "A2", {"source": "f"}, [1.0, 0.0])], kinds))
    assert c.count() == 3 and [r.text for r in c.by_ids(["b", "zz", "a"]).collect()] == ["B", "A2"]
    with pytest.raises(ValueError):
        c.upsert(spark.createDataFrame([("x", " ", None, None)], kinds))
    c.delete(["nope", "b"])
    c.delete_sources(["f"])
    assert [r.id for r in c.all().collect()] == ["c"] and collection_names(spark, str(tmp_path)) == ["c"]
    c.clear()
    assert c.count() == 0


def test_last_arrival_and_broken_writes(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "c")
    kinds = "id string, text string, at int"
    c.upsert(spark.createDataFrame([("a", "zzz old", 1), ("a", "aaa new", 2), ("b", "x", 3)], kinds))
    assert {r.id: r.text for r in c.all().collect()} == {"a": "aaa new", "b": "x"}
    c.upsert(spark.createDataFrame([("a", "first", 9), ("a", "second", 5)], kinds), "at")
    assert {r.id: r.text for r in c.all().collect()} == {"a": "first", "b": "x"}
    reader = c.all()
    c.delete(["b"])
    assert reader.count() == 2  # the snapshot before the last one stays
    (tmp_path / "c" / "v-000000000099-broken").mkdir()  # a writer that died
    assert [r.id for r in c.all().collect()] == ["a"] and collection_names(spark, str(tmp_path)) == ["c"]
    index = Index(spark, str(tmp_path), "i")
    index.add([document("old", id="x"), document("new", id="x")])
    assert [r.text for r in index.collection.all().collect()] == ["new"]


def test_keyword_index(spark, tmp_path):
    from quillon.operators.keyword import KeywordIndex

    d = docs(spark, [*HYBRID, ("d4", "", None), ("d5", None, None), ("d6", "the the cat", None)])
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert not index.exists()
    index.build(d)
    for query in ("cat the", "cat cat dog", "nothing", ""):
        want = {r.id: r.score for r in keyword.bm25(d, query).collect()}
        got = {r.key: r.score for r in index.scores(query).collect()}
        assert index.exists() and set(got) <= set(want) and {i: got.get(i, 0.0) for i in want} == pytest.approx(want)


def test_knowledge_graph_and_index_evaluation(spark, tmp_path):
    kg = graph.KnowledgeGraph(spark)
    kg.add(docs(spark, [("1", "Alice met Bob", None), ("2", "Bob saw Carol", None)]))
    assert kg.counts() == {"entities": 3, "edges": 2} and kg.entity("BOB").first().documents == 2
    assert {r.key for r in kg.neighbours("alice", 2).collect()} == {"bob", "carol"} and kg.related("Alice", 1).count() == 2
    kg.add(docs(spark, [("2", "Dave left", None)]))
    assert kg.counts() == {"entities": 3, "edges": 1}
    kg.clear()
    assert kg.counts() == {"entities": 0, "edges": 0}
    index = Index(spark, str(tmp_path), "e")
    index.add([document(t, id=i) for i, t, _ in HYBRID])
    got = index.evaluate(["cat mat", "machine learning", "zebra"], [["d1"], ["d3"], []], 1)
    assert got == {"queries": 3, "mrr": pytest.approx(2 / 3, abs=1e-6), "ndcg": pytest.approx(2 / 3, abs=1e-6), "recall": pytest.approx(2 / 3, abs=1e-6)}
    with pytest.raises(ValueError):
        index.evaluate(["a"], [])
    assert isinstance(index.collection, Store)


def test_cross_encoder_is_an_adapter():
    from quillon.operators import search

    assert search.scorer("lexical") is None and search.scorer("some/model").model == "some/model" and search.CrossEncoder()("q", []) == []
    with pytest.raises(ImportError):
        search.CrossEncoder("none")("q", ["t"])


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "dot"])
def test_knn_join(spark, metric):
    from quillon.operators.search import knn_join

    rng = random.Random(5)
    x = [[float(rng.randint(-3, 3)) or 1.0 for _ in range(4)] for _ in range(60)]
    rows = spark.createDataFrame([(f"r{i:02d}", v) for i, v in enumerate(x)] + [("short", [1.0]), ("none", None)], "id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i]) for i in range(5)], "query_id long, embedding array<float>")

    def d(a, b):
        if metric == "l2sq":
            return sum((p - q) ** 2 for p, q in zip(a, b))
        dot = sum(p * q for p, q in zip(a, b))
        return -dot if metric == "dot" else 1 - dot / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5

    got = {(r.query_id, r["rank"]): r.id for r in knn_join(asked, rows, 4, metric).collect()}
    want = {(i, n + 1): key for i in range(5) for n, (_, key) in enumerate(sorted((round(d(x[i], v), 12) + 0.0, f"r{j:02d}") for j, v in enumerate(x))[:4])}
    assert got == want
    assert knn_join(asked.limit(0), rows, 4, metric).collect() == []


HYBRID = [("d1", "the cat sat on the mat", {"k": "animals"}), ("d2", "the dog ran in the park", {"k": "animals"}), ("d3", "machine learning is great", {"k": "tech"})]


def test_bm25_and_fusion(spark):
    d = docs(spark, HYBRID)
    score = {r.id: r.score for r in keyword.bm25(d, "cat").collect()}
    assert score == pytest.approx({"d1": 0.483622, "d2": 0.0, "d3": 0.0}, abs=1e-6)
    assert {r.id: r.score for r in keyword.bm25(d, "cat sat mat").collect()}["d1"] == pytest.approx(1.450866, abs=1e-5)
    near = spark.createDataFrame([("d1", 0), ("d3", 1), ("d2", 2)], "id string, rank long")
    words = keyword.ranks(keyword.bm25(d, "cat"), [F.desc("score"), F.col("id")])
    assert [(r.id, round(r.distance, 6)) for r in keyword.fuse(near, words).orderBy("distance", "id").collect()] == [("d1", 0.983607), ("d2", 0.983999), ("d3", 0.983999)]
    with pytest.raises(ValueError):
        keyword.fuse(near, words, 1.5)
    assert keyword.bm25(d, " ").agg(F.max("score")).first()[0] == 0.0


def test_ranks_over_partitions(spark):
    rows = spark.range(1000).repartition(7).withColumn("x", F.col("id") % 10)
    got = keyword.ranks(rows, [F.col("x"), F.col("id")]).orderBy("rank").collect()
    assert [r.id for r in got] == sorted(range(1000), key=lambda i: (i % 10, i)) and [r["rank"] for r in got] == list(range(1000))


def test_graph(spark, tmp_path):
    d = docs(spark, [("d1", "Alice met Bob at the Conference.", None), ("d2", "Bob works with Carol.", None), ("d3", None, None)])
    m = graph.entity_mentions(d)
    e = graph.graph_edges(m)
    assert {(r.src, r.dst, r.weight) for r in e.collect()} == {("alice", "bob", 1), ("alice", "conference", 1), ("bob", "conference", 1), ("bob", "carol", 1)}
    assert {r.key: r.hop for r in graph.neighbours(e, "ALICE", 1).collect()} == {"bob": 1, "conference": 1}
    assert {r.key: r.hop for r in graph.neighbours(e, "alice", 2).collect()} == {"bob": 1, "conference": 1, "carol": 2}
    assert graph.neighbours(e, "nobody", 2).collect() == []
    assert {(r.id, r.hop) for r in graph.related_documents(m, e, "Alice", 2).collect()} == {("d1", 0), ("d2", 1)}
    graph.save_graph(graph.graph_nodes(m), e, str(tmp_path / "g.json"))
    assert "alice||bob" in json.load(open(tmp_path / "g.json"))["edges"]
    n2, e2 = graph.load_graph(spark, str(tmp_path / "g.json"))
    assert n2.count() == 4 and {(r.src, r.dst, r.weight) for r in e2.collect()} == {(r.src, r.dst, r.weight) for r in e.collect()}
    names = spark.createDataFrame([("The quick brown fox. Machine Learning in Natural Language Processing",)], "t string").select(graph.entity_names("t")).first()[0]
    assert names == ["Machine Learning", "Natural Language Processing"]
    with pytest.raises(ValueError):
        graph.neighbours(e, "alice", 0)


def test_graph_fusion(spark):
    ranking = spark.createDataFrame([("d1", 0), ("d2", 1)], "id string, rank long")
    near = spark.createDataFrame([("d1", 0), ("d3", 1), ("gone", 2)], "id string, rank long")
    known = docs(spark, [("d1", "a", None), ("d2", "b", None), ("d3", "c", None)])
    assert [(r.id, round(r.distance, 6)) for r in graph.graph_fusion(ranking, near, known, 5).collect()] == [("d1", 0.983333), ("d2", 0.991803), ("d3", 0.991803)]


def test_evaluation(spark):
    shown = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, id string, rank int")
    right = spark.createDataFrame([(1, "b"), (1, "zz"), (3, "q")], "query_id int, id string")
    rows = {r.query_id: (r.reciprocal_rank, r.ndcg, r.recall) for r in evaluate.evaluate(shown, right).collect()}
    assert rows == {1: (0.5, 0.63093, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert tuple(evaluate.summary(evaluate.evaluate(shown.limit(0), right.limit(0))).first()) == (0, 0.0, 0.0, 0.0)


def test_search_helpers(spark):
    rows = spark.createDataFrame([("1", "a x", 0.1), ("2", "b q r", 0.2), ("3", "q", 0.3)], "id string, text string, distance double")
    got = search.reranked(rows, "q r", 2, score=lambda q, ts: [{"a x": 0.1, "b q r": 0.9, "q": 0.5}[t] for t in ts]).collect()
    assert [(r.id, r.rerank_score) for r in got] == [("2", 0.9), ("3", 0.5)]
    a = spark.createDataFrame([("x", 0.1)], "id string, distance double")
    b = spark.createDataFrame([("y", 0.05)], "id string, distance double")
    assert [(r._collection, r.id) for r in search.merged({"docs": a, "code": b}, 2).collect()] == [("code", "y"), ("docs", "x")]
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(99, None), (98, [1.0])], "id long, embedding array<float>")
    asked = v.where("id = 3").select(F.col("id").alias("query_id"), "embedding")
    assert [(r.id, r.distance) for r in search.knn_join(asked, v, 3, "l2sq").orderBy("rank").collect()] == [(3, 0.0), (2, 1.0), (4, 1.0)]


def test_prompt(spark):
    rows = spark.createDataFrame([(1, "x", "one {b}", {"source": "a.md", "chunk_index": "2"}), (2, "abcdefghijklmnop", "two", None)], "rank int, id string, text string, metadata map<string,string>")
    text = prompt.prompt("why?", rows)
    assert "[1] one {b}\n(source: a.md#chunk2)" in text and "[2] abcdefghijkl" in text and text.endswith("Question: why?\n")
    assert "(source" not in prompt.results_only(rows) and "(none)" in prompt.prompt("q", rows.limit(0))


def test_cache_and_timing():
    c = EmbeddingCache(2)
    for t in "abc":
        c.put(t, [1.0])
    assert c.get("a") is None and c.get("b") == [1.0] and (c.hits, c.misses) == (1, 1)
    asked = []
    assert c.get_or_compute(["b", "n", "n"], lambda ts: asked.append(ts) or [[2.0]] * len(ts)) == [[1.0], [2.0], [2.0]] and asked == [["n"]]
    none = EmbeddingCache(0)
    none.put("a", [1.0])
    assert len(none) == 0
    reset_timings()
    with pytest.raises(ZeroDivisionError):
        timed("x")(lambda: 1 / 0)()
    assert timings()["x"]["calls"] == 1


def test_loaders(spark, tmp_path):
    root = tmp_path / "r"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("text a")
    (root / "sub" / "b.txt").write_text("text b")
    (root / "c.py").write_text("x")
    (root / "bad.txt").write_bytes(b"\xff\xfe" * 200)
    (tmp_path / "out.txt").write_text("outside")
    os.symlink(tmp_path / "out.txt", root / "link.txt")
    assert sorted(r.text for r in loaders.load_directory(spark, str(root)).collect()) == ["text a", "text b"]
    assert [r.text for r in loaders.load_directory(spark, str(root), "*.txt").collect()] == ["text a"]
    (root / "d.md").write_text("---\ntitle: 'Hello'\nempty:\nauthor: Test\n---\n# Content\n")
    (root / "e.csv").write_text("name,age\nAlice,30\nBob,25\n")
    (root / "f.html").write_text("<nav>no</nav><p>Hi <b>you</b></p><script>x</script>")
    (root / "g.rtf").write_bytes(rb"{\rtf1{\fonttbl x}Caf\'e9\par two}")
    with zipfile.ZipFile(root / "h.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:d>')
    with zipfile.ZipFile(root / "i.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>name</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row/></w>')
    got = {r.metadata["filename"]: r for r in loaders.load_directory(spark, str(root), "**/*.*").collect()}
    assert got["d.md"].text == "# Content" and got["d.md"].metadata["title"] == "Hello" and "empty" not in got["d.md"].metadata
    assert got["e.csv"].text == "name, age\nAlice, 30\nBob, 25" and got["f.html"].text == "Hi\nyou"
    assert got["g.rtf"].text == "Café\ntwo" and got["h.docx"].text == "One\n\nTwo" and got["i.xlsx"].text == "name, , 7"
    with pytest.raises(FileNotFoundError):
        loaders.load_text(spark, str(root / "none"))


def test_jsonl(spark, tmp_path):
    assert loaders.export_jsonl(docs(spark, HYBRID), str(tmp_path / "x")) == 3
    assert loaders.import_jsonl(spark, str(tmp_path / "x")).count() == 3
    (tmp_path / "y.jsonl").write_text('{"text": "a"}\nnot json\n\n{"id": "q"}\n{"id": "z", "text": "b", "metadata": {"k": "v"}}\n')
    assert {(len(r.id), r.text) for r in loaders.import_jsonl(spark, str(tmp_path / "y.jsonl")).collect()} == {(64, "a"), (1, "b")}


def test_sync_and_watch(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("two")
    index = Index(spark, str(tmp_path / "db"))
    assert incremental.sync_directory(spark, str(root), index.collection, index.embed) == {"new": 2}
    (root / "a.txt").write_text("three")
    (root / "b.txt").unlink()
    assert incremental.sync_directory(spark, str(root), index.collection, index.embed) == {"changed": 1, "deleted": 1}
    assert [r.text for r in index.collection.all().collect()] == ["three"]
    stream = change_stream(spark, str(root), [".txt"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        stream.processAllAvailable()
        (root / "c.txt").write_text("new")
        (root / "a.txt").unlink()
        stream.processAllAvailable()
    finally:
        stream.stop()
    last = {os.path.basename(r.path): r.op for r in fold_changes(spark.table("seen")).collect()}
    assert last == {"a.txt": "delete", "c.txt": "upsert"}


def test_engine_and_services(spark, tmp_path):
    index = Index(spark, str(tmp_path), "one")
    index.add([document("the cat sat on the mat", {"k": "animals"}), document("the dog ran", {"k": "animals"}), "ignored" and document("machine learning is great", {"k": "tech"})])
    assert index.query("machine learning", 1).first().text == "machine learning is great"
    assert index.hybrid_query("cat", 2).orderBy("rank").first().text.startswith("the cat")
    assert index.query("cat", 3, {"k": "tech"}).count() == 1 and index.query("cat dog", 2, rerank=True).count() == 2
    assert index.query_parent("cat", 2).count() == 2 and "Question: cat" in index.query_for_prompt("cat", 1)
    m = graph.entity_mentions(index.collection.all())
    assert index.graph_query("cat", m, graph.graph_edges(m), 2).count() == 2
    for bad in (lambda: index.query(" "), lambda: index.query("x", 0), lambda: index.add([document(" ")])):
        with pytest.raises(ValueError):
            bad()
    assert Router({"one": index}).query("cat", 1, ["one", "none"]).first()._collection == "one"
    routes = Routes(index)
    assert routes.health({}) == {"status": "ok"} and routes.stats({})["documents"] == 3 and routes.collections({}) == {"collections": ["one"]}
    assert len(routes.query({"query": "cat", "top_k": 10**6})["results"]) == 3 and routes.add({"documents": ["new text", {"text": "x"}]})["total"] == 5
    body = routes.openapi({})["paths"]["/query"]["post"]["requestBody"]["content"]["application/json"]["schema"]
    assert body["required"] == ["query"] and body["properties"]["top_k"] == {"type": "integer"}
    assert "/query" in routes.openapi({})["paths"] and "cache" in routes.metrics({})
    assert mcp.answer(index, "{")["error"]["code"] == -32700 and mcp.answer(index, '{"id": 1, "method": "zzz"}')["error"]["code"] == -32601
    call = lambda name, **a: mcp.answer(index, json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}))["result"]
    assert json.loads(call("collection_info")["content"][0]["text"])["documents"] == 5 and call("nope")["isError"] and "results" in call("search", query="cat", top_k=1)["content"][0]["text"]
    runs = Pipeline(lambda: docs(spark, [("p", "one two\nthree", None)]), index, lambda d: split.split_tokens(d, 2, 0))
    assert runs.run() == {"loaded": 1, "chunked": 2, "indexed": 2, "errors": 0}
    assert Pipeline(lambda: 1 / 0, index).run()["errors"] == 1
    with pytest.raises(ZeroDivisionError):
        Pipeline(lambda: 1 / 0, index, on_error="raise").run()


def test_http(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    server = make_server(Index(spark, str(tmp_path), "h"), port=0, api_key="k", cors_origin="*")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None, key="k"):
        r = urllib.request.Request(url + path, body, {"Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(r) as a:
                return a.status, json.loads(a.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health") == (200, {"status": "ok"}) and ask("/health", key="x")[0] == 401 and ask("/zz")[0] == 404
        assert ask("/query", b"{")[0] == 400 and ask("/query", b"{}")[0] == 400 and ask("/index", b'{"documents": [1]}')[0] == 400
    finally:
        server.shutdown()


def test_backends_sort_and_refuse(monkeypatch):
    from quillon.operators import embed

    monkeypatch.setattr(embed, "_post", lambda *a: {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert OpenAIBackend(api_key="k").encode(["a", "b"]) == [[1.0], [2.0]]
    monkeypatch.setattr(embed, "_post", lambda *a: {})
    with pytest.raises(ValueError):
        embed.OllamaBackend().encode(["a"])


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "quillon.toml").write_text('[index]\npersist_dir = "./file"\ntypo = 1\n[search]\ntop-k = 9\n[server]\nport = 99999\n')
    monkeypatch.setenv("QUILLON_DB", "/env")
    monkeypatch.setenv("QUILLON_PORT", "no")
    s = load_settings(str(tmp_path))
    assert s.index.persist_dir == "/env" and s.search.top_k == 9 and s.server.port == 8484
