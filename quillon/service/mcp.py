"""Model context protocol over standard input and output: one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from quillon import __version__

_SEARCH = {"query": {"type": "string"}, "top_k": {"type": "integer", "default": 5}}
TOOLS = [
    {"name": "search", "description": "Passages of the collection that fit a query.", "inputSchema": {"type": "object", "properties": _SEARCH, "required": ["query"]}},
    {"name": "get_prompt", "description": "A prompt with the passages that fit a question.", "inputSchema": {"type": "object", "properties": _SEARCH, "required": ["query"]}},
    {"name": "collection_info", "description": "Name and size of the collection.", "inputSchema": {"type": "object", "properties": {}}},
]


def call(index, name: str, arguments: dict) -> str:
    text, k = arguments.get("query", ""), int(arguments.get("top_k", 5))
    if name == "search":
        rows = index.query(text, k).orderBy("rank").select("text", "citation", "distance").collect()
        return json.dumps({"results": [r.asDict() for r in rows]}, ensure_ascii=False)
    if name == "get_prompt":
        return index.query_for_prompt(text, k)
    if name == "collection_info":
        return json.dumps({"documents": index.count(), "collection": index.collection.name})
    raise ValueError(f"unknown tool {name}")


def answer(index, line: str) -> dict | None:
    """The reply to one line, None where none is due."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
    method, params = request.get("method", ""), request.get("params") or {}
    if method == "notifications/initialized":
        return None
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quillon", "version": __version__}}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        try:
            return reply | {"result": {"content": [{"type": "text", "text": call(index, params.get("name", ""), params.get("arguments") or {})}]}}
        except Exception as e:  # noqa: BLE001 - the client is told
            return reply | {"result": {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}}
    return reply | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def run(index, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if line.strip() and (reply := answer(index, line)) is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
