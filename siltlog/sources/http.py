"""A small HTTP front for a store, for trying things out: one Spark job for each request."""

from __future__ import annotations

import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

MOST_BYTES = 10 * 1024 * 1024
DEFAULT_LIMIT = 100


class Refused(Exception):
    """A request at fault: an HTTP status and why."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def limit_of(text: str | None) -> int:
    """The whole number that a text begins with, 100 for none; below one or not a number is refused."""
    if text is None:
        return DEFAULT_LIMIT
    found = re.match(r"\s*([+-]?\d+)", text)
    if not found or int(found[1]) < 1:
        raise Refused(400, "invalid limit")
    return int(found[1])


def pairs_of(body: dict) -> list[tuple]:
    """The pairs of a batch, from `entries` or from `keys` and `values` of one length; the first at fault is named."""
    if isinstance(body.get("entries"), list):
        pairs = [(e.get("key"), e.get("value")) if isinstance(e, dict) else (None, None) for e in body["entries"]]
    elif isinstance(body.get("keys"), list) and isinstance(body.get("values"), list):
        if len(body["keys"]) != len(body["values"]):
            raise Refused(400, "keys and values differ in length")
        pairs = list(zip(body["keys"], body["values"], strict=True))
    else:
        raise Refused(400, "entries, or keys and values, are needed")
    if not pairs:
        raise Refused(400, "the batch is empty")
    for i, (key, value) in enumerate(pairs):
        if not isinstance(key, str) or not key or value is None:
            raise Refused(400, f"invalid entry at index {i}")
    return pairs


def answer(store, method: str, target: str, raw: bytes = b"", replication=None) -> tuple[int, dict]:
    """Status and body for a request. Paths are percent-decoded, a plus sign stays one; of repeated parameters the last counts."""
    url = urlsplit(target)
    query = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
    try:
        if method == "GET" and url.path == "/health":
            return 200, {"status": "ok", "timestamp": int(time.time() * 1000)}
        if method == "GET" and url.path == "/replication/status":
            return 200, {"enabled": replication is not None, **(replication() if replication else {})}
        if method == "POST" and url.path in ("/put", "/batch-put"):
            if len(raw) > MOST_BYTES:
                raise Refused(500, "the body is too large")
            try:
                body = json.loads(raw)
            except ValueError as e:
                raise Refused(500, "the body is not JSON") from e
            if body is None:
                raise Refused(500, "the body is null")
            if not isinstance(body, dict):
                raise Refused(400, "the body is not an object")
            if url.path == "/batch-put":
                return 200, {"success": True, "count": store.batch_put(pairs_of(body))}
            if not isinstance(body.get("key"), str) or not body["key"] or body.get("value") is None:
                raise Refused(400, "a key and a value are needed")
            store.put(body["key"], body["value"])
            return 200, {"success": True}
        found = re.fullmatch(r"/(get|delete)/([^/]+)", url.path)
        if found and (method, found[1]) in (("GET", "get"), ("DELETE", "delete")):
            key = unquote(found[2])
            if method == "DELETE":
                store.delete(key)
                return 200, {"success": True}
            value = store.get(key)
            if value is None:
                raise Refused(404, "no such key")
            return 200, {"key": key, "value": value}
        if method == "GET" and url.path == "/range":
            if not query.get("start") or not query.get("end"):
                raise Refused(400, "start and end are needed")
            # `after` asks for the next page: keys behind the last one of the page before
            rows = store.range(query["start"], query["end"], limit_of(query.get("limit")), query.get("after")).collect()
            return 200, {"count": len(rows), "results": [{"key": r["key"], "value": r["value"]} for r in rows]}
        raise Refused(404, "no such route")
    except Refused as e:
        return e.status, {"error": str(e)}
    except (TypeError, ValueError) as e:
        return 400, {"error": str(e)}
    except PermissionError as e:
        return 403, {"error": str(e)}


def serve(store, port: int = 0, replication=None) -> ThreadingHTTPServer:
    """A server for the store; call serve_forever() on it. Requests run side by side, so their writes share a commit."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            n = int(self.headers.get("Content-Length") or 0)
            status, body = answer(store, self.command, self.path, self.rfile.read(min(n, MOST_BYTES + 1)), replication)
            out = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *_):
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
