"""The index over HTTP: search, index, status and embeddings, as JSON.

``Service.answer`` maps a request to a status and a reply; ``serve`` puts it behind the
standard library's server. One Spark session answers all requests.
"""

from __future__ import annotations

import json
import os
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quillspark.operators import indexing, reports, store

MODES = ("hybrid", "vector", "bm25")
#: Results of one request at most: candidates, five times as many, pass through the driver.
MOST_RESULTS = 1000


class Refused(Exception):
    """A request that gets an error: status and reason."""


class Service:
    def __init__(self, held: store.SnapshotStore | None = None, embedder=None, home: str | None = None):
        """``home``: the directory that paths to index must lie in; the user's unless given."""
        self.held, self.embedder = held, embedder
        self.home = os.path.realpath(home or os.path.expanduser("~"))

    def answer(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        routes = {("POST", "/search"): self._search, ("POST", "/index"): self._index, ("GET", "/status"): self._status, ("POST", "/v1/embeddings"): self._embeddings}
        route = routes.get((method, path.split("?")[0].rstrip("/") or "/"))
        if route is None:
            return 404, {"detail": "Not found"}
        if self.held is None and route != self._status:
            return 503, {"detail": "Not initialised"}
        if body is not None and not isinstance(body, dict):
            return 422, {"detail": "The body isn't an object"}
        try:
            return 200, route(body or {})
        except Refused as e:
            return e.args[0], {"detail": e.args[1]}

    @staticmethod
    def _wanted(body: dict, key: str, kind, default=None):
        value = body.get(key, default)
        if not isinstance(value, kind):
            raise Refused(422, f"{key} is missing or of the wrong type")
        return value

    def _search(self, body: dict) -> dict:
        query, top_k = self._wanted(body, "query", str), self._wanted(body, "top_k", int, 10)
        if isinstance(top_k, bool) or not 0 < top_k <= MOST_RESULTS:
            raise Refused(422, f"top_k is from 1 to {MOST_RESULTS}")
        if (mode := body.get("mode", "hybrid")) not in MODES:
            raise Refused(422, f"mode is one of {', '.join(MODES)}")
        rows = self.held.search(self.embedder.embed_query(query), query, top_k, body.get("repo"), mode).drop("id").collect()
        return {"results": [r.asDict() for r in rows]}

    def _index(self, body: dict) -> dict:
        path = os.path.realpath(os.path.expanduser(self._wanted(body, "path", str)))
        if not os.path.exists(path):
            raise Refused(404, f"Path not found: {path}")
        if os.path.commonpath([path, self.home]) != self.home:
            raise Refused(400, "Only paths inside the home directory may be indexed")
        told = indexing.index_path(self.held, path, datetime.now(), self.embedder)
        return {"indexed": told["embedded"] + told["reused"], "path": path}

    def _status(self, body: dict) -> dict:
        if self.held is None:
            return {"status": "not_initialised", "chunks": 0, "repos": []}
        chunks, _ = self.held.read()
        repos = [{"repo": r["repo"], "chunks": r["chunks"], "last_indexed": r["last_indexed"] and r["last_indexed"].isoformat()} for r in reports.list_repos(chunks).collect()]
        return {"status": "ok", "chunks": reports.count(chunks).first()["chunks"], "repos": repos, "db": self.held.path}

    def _embeddings(self, body: dict) -> dict:
        texts = self._wanted(body, "input", (str, list))
        texts = [texts] if isinstance(texts, str) else texts
        data = [{"object": "embedding", "index": i, "embedding": list(v)} for i, v in enumerate(self.embedder.embed(texts))]
        return {"object": "list", "data": data, "model": body.get("model", self.embedder.model_name), "usage": {"prompt_tokens": 0, "total_tokens": 0}}


def serve(service: Service, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the service; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self):
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
                status, reply = service.answer(self.command, self.path, body)
            except json.JSONDecodeError:
                status, reply = 400, {"detail": "The body isn't JSON"}
            told = json.dumps(reply).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(told)))
            self.end_headers()
            self.wfile.write(told)

        do_GET = do_POST = _reply

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
