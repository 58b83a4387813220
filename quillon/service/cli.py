"""Command line: python -m quillon.service.cli COMMAND."""

from __future__ import annotations

import argparse
import importlib.util
import logging
import sys
import time

from quillon.config import Settings, load_settings


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillon").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_index(args, settings: Settings, spark=None):
    from quillon.engine import Index
    from quillon.operators.embed import HashingBackend, ModelBackend

    model = args.model or settings.index.model
    backend = HashingBackend(int(model.rpartition("-")[2])) if model.startswith("hashing-") else ModelBackend(model)
    return Index(spark or _session(), args.db or settings.index.persist_dir, args.collection or settings.index.collection, backend, batch_size=settings.index.batch_size, rerank_model=settings.search.rerank_model)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon")
    common = argparse.ArgumentParser(add_help=False)
    for name in ("--db", "--collection", "--model"):
        common.add_argument(name)
    common.add_argument("-v", "--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, text: sub.add_parser(name, help=text, parents=[common])
    p = add("index", "index a folder; only new and changed files are read into the collection")
    p.add_argument("path")
    p.add_argument("--glob")
    w = add("watch", "keep a collection up to date with a folder")
    w.add_argument("path")
    w.add_argument("--extensions", help="joined by commas")
    for x in (p, w):
        x.add_argument("--chunk-size", type=int)
        x.add_argument("--chunk-overlap", type=int)
    q = add("query", "search")
    q.add_argument("text")
    q.add_argument("--rerank", action=argparse.BooleanOptionalAction)
    q.add_argument("--hybrid", action=argparse.BooleanOptionalAction)
    q.add_argument("--alpha", type=float)
    r = add("prompt", "prompt with context")
    r.add_argument("text")
    for x in (q, r):
        x.add_argument("-k", "--top-k", type=int)
    s = add("serve", "HTTP service")
    s.add_argument("--host")
    s.add_argument("--port", type=int)
    add("info", "size of the collection")
    e = add("export", "JSON lines")
    e.add_argument("-o", "--output", required=True)
    add("import", "JSON lines").add_argument("path")
    add("doctor", "what is installed and reachable")
    add("mcp", "model context protocol on standard input and output")
    add("benchmark", "documents and queries a second").add_argument("--queries", type=int, default=10)
    return top


def _split(args, settings):
    from functools import partial

    from quillon.operators.split import split_characters

    size = settings.index.chunk_size if args.chunk_size is None else args.chunk_size
    overlap = settings.index.chunk_overlap if args.chunk_overlap is None else args.chunk_overlap
    return partial(split_characters, size=size, overlap=overlap)


def benchmark(index, queries: int) -> dict[str, float]:
    from quillon.engine import document

    out = {}
    if index.count() == 0:
        began = time.perf_counter()
        index.add([document(f"Document number {i} tells of topic {i % 10} in one sentence.") for i in range(100)])
        out["documents_per_second"] = 100 / (time.perf_counter() - began)
    index.cache.clear()
    for name in ("cold", "warm"):
        began = time.perf_counter()
        for i in range(queries):
            index.query(f"topic {i}").collect()
        out[f"{name}_ms_per_query"] = (time.perf_counter() - began) * 1000 / max(queries, 1)
    return out | {"cache_hits": index.cache.hits, "cache_misses": index.cache.misses}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    settings = load_settings()
    if args.command == "doctor":
        for name in ("pyspark", "pyarrow", "pandas", "numpy", "sentence_transformers", "pymupdf4llm", "tokenizers"):
            print(f"{name}: {'installed' if importlib.util.find_spec(name) else 'missing'}")
        print(f"session: Spark {_session().version}")
        return 0
    index = open_index(args, settings)
    spark = index.spark
    if args.command == "index":
        from quillon.sources.incremental import sync_directory

        print(sync_directory(spark, args.path, index.collection, index.embed, _split(args, settings), args.glob or settings.index.glob))
    elif args.command == "watch":
        from quillon.streaming.watch import watch

        ends = args.extensions.split(",") if args.extensions else settings.watch.extensions
        watch(spark, args.path, index.collection, index.embed, _split(args, settings), ends).awaitTermination()
    elif args.command == "query":
        k, s = args.top_k or settings.search.top_k, settings.search
        if s.hybrid if args.hybrid is None else args.hybrid:
            rows = index.hybrid_query(args.text, k, alpha=s.alpha if args.alpha is None else args.alpha).orderBy("rank").collect()
        else:
            rows = index.query(args.text, k, rerank=s.rerank if args.rerank is None else args.rerank).orderBy("rank").collect()
        for r in rows:
            print(f"{r['rank']}. [{r['distance']:.4f}] {r['citation']}\n   {r['text'][:200]}")
        return 0 if rows else 1
    elif args.command == "prompt":
        print(index.query_for_prompt(args.text, args.top_k or settings.search.top_k))
    elif args.command == "serve":
        from quillon.service.http import serve

        s = settings.server
        serve(index, host=args.host or s.host, port=s.port if args.port is None else args.port, api_key=s.api_key, cors_origin=s.cors_origin)
    elif args.command == "info":
        print(f"{index.collection.name}: {index.count()} documents in {index.collection.path}")
    elif args.command == "export":
        from quillon.sources.loaders import export_jsonl

        print(export_jsonl(index.collection.all(), args.output))
    elif args.command == "import":
        from quillon.sources.loaders import import_jsonl

        index.add(import_jsonl(spark, args.path))
        print(index.count())
    elif args.command == "mcp":
        from quillon.service.mcp import run

        run(index)
    elif args.command == "benchmark":
        for k, v in benchmark(index, args.queries).items():
            print(f"{k}: {v:.1f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
