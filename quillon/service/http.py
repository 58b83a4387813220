"""HTTP service on the driver: a table of routes over one Index."""

from __future__ import annotations

import hmac
import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quillon.operators.collection import collection_names
from quillon.timing import timings

log = logging.getLogger(__name__)
MOST_BODY, MOST_K = 10 * 1024 * 1024, 1000


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy("rank").collect()]


def _wanted(body: dict) -> str:
    if not isinstance(body.get("query"), str) or not body["query"].strip():
        raise Refused(400, "Missing 'query' field")
    return body["query"]


#: Fields of the requests and replies by path: name and type, required ones marked with a star.
_REQUESTS = {
    "/query": "query* string, top_k integer, where object, rerank boolean, hybrid boolean, alpha number",
    "/prompt": "query* string, top_k integer, where object, template string",
    "/index": "documents* array",
}
_REPLIES = {
    "/health": "status string", "/stats": "documents integer, collection string", "/collections": "collections array", "/metrics": "documents integer, timings object, cache object",
    "/query": "query string, results array", "/prompt": "query string, prompt string", "/index": "indexed integer, total integer",
}


def _schema(fields: str) -> dict:
    pairs = [f.split() for f in fields.split(", ") if f]
    needed = [name[:-1] for name, _ in pairs if name.endswith("*")]
    return {"type": "object", "properties": {name.rstrip("*"): {"type": kind} for name, kind in pairs}} | ({"required": needed} if needed else {})


class Routes:
    """Answers by (method, path), without any HTTP, so that they can be tested alone."""

    def __init__(self, index):
        self.index = index
        self.table = {
            ("GET", "/health"): (self.health, "Whether the service runs"),
            ("GET", "/stats"): (self.stats, "Number of documents"),
            ("GET", "/collections"): (self.collections, "Names of the collections"),
            ("GET", "/metrics"): (self.metrics, "Timings and cache counters"),
            ("GET", "/openapi.json"): (self.openapi, "This description"),
            ("POST", "/query"): (self.query, "Search: query, top_k, where, rerank, hybrid, alpha"),
            ("POST", "/prompt"): (self.prompt, "Prompt with context: query, top_k, where, template"),
            ("POST", "/index"): (self.add, "Add documents: strings or objects of text, metadata, id"),
        }

    def health(self, body):
        return {"status": "ok"}

    def stats(self, body):
        return {"documents": self.index.count(), "collection": self.index.collection.name}

    def collections(self, body):
        return {"collections": collection_names(self.index.spark, self.index.folder)}

    def metrics(self, body):
        c = self.index.cache
        return {"documents": self.index.count(), "timings": timings(), "cache": {"size": len(c), "hits": c.hits, "misses": c.misses}}

    def openapi(self, body):
        paths: dict = {}
        for (method, path), (_, text) in self.table.items():
            content = lambda fields: {"content": {"application/json": {"schema": _schema(fields)}}}
            entry = {"summary": text, "responses": {"200": {"description": "OK", **content(_REPLIES.get(path, ""))}}}
            if path in _REQUESTS:
                entry["requestBody"] = {"required": True, **content(_REQUESTS[path])}
                entry["responses"]["400"] = {"description": "The request can't be read", **content("error string")}
            paths.setdefault(path, {})[method.lower()] = entry
        return {"openapi": "3.0.3", "info": {"title": "quillon", "version": "1"}, "paths": paths}

    def query(self, body):
        text, k = _wanted(body), min(max(int(body.get("top_k", 5)), 1), MOST_K)
        if body.get("hybrid"):
            found = self.index.hybrid_query(text, k, body.get("where"), float(body.get("alpha", 0.5)))
        else:
            found = self.index.query(text, k, body.get("where"), bool(body.get("rerank")))
        return {"query": text, "results": _rows(found)}

    def prompt(self, body):
        text = _wanted(body)
        return {"query": text, "prompt": self.index.query_for_prompt(text, int(body.get("top_k", 5)), body.get("where"), body.get("template"))}

    def add(self, body):
        docs = body.get("documents")
        if not isinstance(docs, list) or not docs:
            raise Refused(400, "Missing 'documents' field")
        rows = []
        for d in docs:
            if isinstance(d, str):
                d = {"text": d}
            if not isinstance(d, dict) or not isinstance(d.get("text"), str):
                raise Refused(400, f"Invalid document: {type(d).__name__}")
            rows.append(d)
        self.index.add(rows)
        return {"indexed": len(rows), "total": self.index.count()}


def make_server(index, host: str = "127.0.0.1", port: int = 8484, api_key: str = "", cors_origin: str = "") -> ThreadingHTTPServer:
    routes = Routes(index)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, format, *args):
            log.debug(format, *args)

        def _send(self, status: int, data: dict | None = None) -> None:
            body = b"" if data is None else json.dumps(data, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            if cors_origin:
                self.send_header("Access-Control-Allow-Origin", cors_origin)
                self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
                self.send_header("Access-Control-Allow-Headers", "Content-Type, Authorization")
            self.end_headers()
            self.wfile.write(body)

        def _body(self) -> dict:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                raise Refused(413, "Payload too large")
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError as e:
                raise Refused(400, f"Invalid JSON: {e}") from e
            if not isinstance(body, dict):
                raise Refused(400, "Invalid JSON: not an object")
            return body

        def _answer(self, method: str) -> None:
            try:
                if api_key and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {api_key}".encode()):
                    raise Refused(401, "Unauthorized")
                found = routes.table.get((method, self.path.split("?")[0].rstrip("/")))
                if not found:
                    raise Refused(404, "Not found")
                self._send(200, found[0](self._body() if method == "POST" else {}))
            except Refused as e:
                self._send(e.status, {"error": str(e)})
            except Exception:
                log.exception("%s %s", method, self.path)
                self._send(500, {"error": "Internal server error"})

        def do_GET(self):
            self._answer("GET")

        def do_POST(self):
            self._answer("POST")

        def do_OPTIONS(self):
            self._send(204)

    return ThreadingHTTPServer((host, port), Handler)


def serve(index, **settings) -> None:
    server = make_server(index, **settings)
    try:
        server.serve_forever()
    finally:
        server.server_close()
