"""The named queries against their SQL, on the smallest tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
from quillon.plans.catalogue import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([x + 0.0 if isinstance(x, float) else x for x in (r[i] for i in order)]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = tables.execute(SQL[name])
        assert plain(df.columns, rows) == plain([c[0] for c in want.description], want.fetchall())


def write_documents(spark, folder, texts):
    rest = {c: F.lit(None).cast(t) for c, t in (("metadata", "map<string,string>"), ("lang", "string"), ("source", "string"), ("embedding", "array<float>"))}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(rest).write.parquet(f"{folder}/documents.parquet")


def test_entities_of_all_texts(spark, tmp_path):
    """Against brute force; umlauts, dashes and no-break spaces keep no text out."""
    import re
    from collections import Counter
    from itertools import combinations

    from quillon.operators.graph import STOP

    texts = ["Alice met Bob.", "Zoë and Alice – Bob Marley, née Müller, in Zürich.", "Éva saw New York and Alice", "The naïve Bob… Alice's Bob", "", None, "ключ Carol_x Dave"]
    write_documents(spark, tmp_path, texts)
    found = {i: [e for e in re.findall(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", t) if len(e) >= 2 and e not in STOP] for i, t in enumerate(texts) if t}
    keys = {i: sorted({e.lower() for e in es}) for i, es in found.items() if es}
    assert {(r.doc_id, r.mentions, r["keys"]) for r in QUERIES["entities_extracted"](spark, str(tmp_path)).collect()} == {(i, len(found[i]), len(ks)) for i, ks in keys.items()}
    first = {}
    for i in sorted(found):
        for e in found[i]:
            first.setdefault(e.lower(), e)
    count = Counter(k for ks in keys.values() for k in ks)
    assert {(r.key, r["name"], r.documents) for r in QUERIES["entity_nodes"](spark, str(tmp_path)).collect()} == {(k, first[k], n) for k, n in count.items()}
    pairs = Counter(p for ks in keys.values() for p in combinations(ks, 2))
    assert {(r.src, r.dst, r.weight) for r in QUERIES["entity_edges"](spark, str(tmp_path)).collect()} == {(*p, n) for p, n in pairs.items()}


def test_html_text_of_all_texts(spark, tmp_path):
    texts = ["<table><tr><td>a</td></tr></table>", "<ul><li>b</li></ul>", "<h2>c</h2>", "<code>d</code>", "<p>e</p>", "plain f", "", None]
    write_documents(spark, tmp_path, texts)
    assert {(r.doc_id, r.text) for r in QUERIES["html_text"](spark, str(tmp_path)).collect()} == {(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "plain f"), (6, "")}
