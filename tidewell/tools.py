"""The engine's operations as named tools with arguments, and a loop that serves them as framed JSON-RPC messages."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from typing import Any, BinaryIO

from pyspark.sql import functions as F

from tidewell import hooks
from tidewell.engine import Engine, NotFound

DEFAULT_HITS, MOST_HITS, LEAST_UPDATE = 5, 50, 50


def _search(engine: Engine, now: datetime, query: str, limit: int = DEFAULT_HITS) -> list[dict]:
    found = engine.search(query, now, record=True, limit=max(1, min(int(limit), MOST_HITS)))
    return [r.asDict() for r in found.select("doc_id", "score", F.substring("content", 1, hooks.SNIPPET).alias("snippet")).collect()]


def _remember(engine: Engine, now: datetime, content: str, category: str = "events", importance: float = 0.5) -> dict:
    return {"id": engine.remember(content, category, now, importance, strict=False)}


def _recall(engine: Engine, now: datetime, query: str, limit: int = DEFAULT_HITS) -> list[dict]:
    return [r.asDict() for r in engine.recall(query, now, max(1, min(int(limit), MOST_HITS))).collect()]


def _verify(engine: Engine, now: datetime) -> dict:
    return {r["status"]: r["count"] for r in engine.verified().groupBy("status").count().collect()}


def _update(engine: Engine, now: datetime, id: str, content: str | None = None, importance: float | None = None) -> dict:  # noqa: A002
    if content is not None and len(content) < LEAST_UPDATE:
        raise ValueError(f"content has fewer than {LEAST_UPDATE} characters")
    if not engine.update_memory(id, now, content, importance):
        raise NotFound(id)
    return {"id": id}


def _consolidate(engine: Engine, now: datetime, dry_run: bool = False) -> dict:
    return engine.consolidate(now, dry_run=bool(dry_run))


TOOLS: dict[str, Callable[..., Any]] = {"search": _search, "remember": _remember, "recall": _recall, "verify": _verify, "update": _update, "consolidate": _consolidate}


def call(engine: Engine, name: str, arguments: dict, now: datetime) -> Any:
    if name not in TOOLS:
        raise NotFound(name)
    return TOOLS[name](engine, now, **arguments)


def respond(engine: Engine, request: dict, now: datetime) -> dict | None:
    """The answer to a JSON-RPC request; None to a notification. Hooks are methods, tools go by tools/call."""
    method, params, ident = request.get("method"), request.get("params") or {}, request.get("id")
    try:
        if method == "tools/list":
            result: Any = {"tools": [{"name": name} for name in TOOLS]}
        elif method == "tools/call":
            result = {"content": [{"type": "text", "text": json.dumps(call(engine, params.get("name"), params.get("arguments") or {}, now), default=str)}]}
        elif method == "session/start":
            result = {"context": hooks.on_start(engine, now)}
        elif method == "session/message":
            result = {"context": hooks.on_message(engine, params.get("message", ""), now)}
        elif method == "session/end":
            result = hooks.on_end(engine, now)
        else:
            return None if ident is None else {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no method {method}"}}
    except (ValueError, TypeError, KeyError) as error:
        return None if ident is None else {"jsonrpc": "2.0", "id": ident, "error": {"code": -32602, "message": str(error)}}
    return None if ident is None else {"jsonrpc": "2.0", "id": ident, "result": result}


def read_message(stream: BinaryIO) -> dict | None:
    """The next message: headers up to an empty line, then as many bytes as Content-Length says. None at the end."""
    length = None
    while True:
        line = stream.readline()
        if not line:
            return None
        if not line.strip():
            break
        name, _, value = line.decode().partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
    return json.loads(stream.read(length)) if length else {}


def write_message(stream: BinaryIO, message: dict) -> None:
    data = json.dumps(message, default=str).encode()
    stream.write(f"Content-Length: {len(data)}\r\n\r\n".encode() + data)
    stream.flush()


def serve(engine: Engine, inputs: BinaryIO, outputs: BinaryIO, clock: Callable[[], datetime]) -> None:
    while (request := read_message(inputs)) is not None:
        answer = respond(engine, request, clock())
        if answer is not None:
            write_message(outputs, answer)
