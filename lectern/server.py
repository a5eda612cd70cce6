"""An HTTP front of the engine, on the standard library.

Routes: GET /health, /formats, /documents, /documents/{id}, /documents/{id}/export, /documents/{id}/elements,
/documents/{id}/chunks; POST /convert, /documents/{id}/query.  An id names a set of documents that were converted
together.  Rows that leave the cluster are limited by ``limit`` and skipped by ``offset``.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.engine import Engine

#: What may be asked for over HTTP.
EXPORTS = ("json", "markdown", "html", "text", "turtle", "ntriples")
ROWS, MOST = 100, 10_000


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Routes:
    """Requests to results, without sockets."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def rows(self, df: DataFrame, query: dict) -> list[dict]:
        try:
            limit, offset = int(query.get("limit", ROWS)), int(query.get("offset", 0))
        except ValueError as e:
            raise Refused(400, f"limit and offset are numbers: {e}") from e
        if not 0 <= limit <= MOST or offset < 0:
            raise Refused(400, f"limit from 0 to {MOST}, offset from 0")
        return [json.loads(r[0]) for r in df.offset(offset).limit(limit).select(F.to_json(F.struct("*"))).collect()]

    def known(self, key: str) -> str:
        if key not in self.engine.sets:
            raise Refused(404, f"no documents under {key!r}")
        return key

    def answer(self, method: str, url: str, body: bytes = b"") -> tuple[int, object]:
        """(status, what is to be sent as JSON)."""
        parts = urlsplit(url)
        query = {k: v[0] for k, v in parse_qs(parts.query).items()}
        try:
            asked = json.loads(body) if body else {}
            for verb, pattern, make in self.table():
                m = re.fullmatch(pattern, parts.path)
                if m and verb == method:
                    return make(*m.groups(), query | asked)
            raise Refused(404, f"no route {method} {parts.path}")
        except Refused as e:
            return e.status, {"error": str(e)}
        except (ValueError, KeyError, TypeError) as e:
            return 400, {"error": f"{type(e).__name__}: {e}"}
        except Exception as e:  # what fails in the cluster is not the asker's fault
            return 500, {"error": f"{type(e).__name__}: {str(e)[:500]}"}

    def table(self):
        key = r"/documents/([^/]+)"
        return [
            ("GET", "/health", lambda q: (200, self.engine.health())),
            ("GET", "/formats", lambda q: (200, {"input": self.rows(self.engine.formats(), q), "output": EXPORTS})),
            ("GET", "/tools", lambda q: (200, self.engine.tools())),
            ("POST", "/convert", self.convert),
            ("GET", "/documents", lambda q: (200, self.rows(self.engine.documents(), q) if self.engine.sets else [])),
            ("GET", key, lambda k, q: (200, {"id": k, "documents": self.rows(self.engine.frames(self.known(k)).docs, q)})),
            ("GET", f"{key}/export", self.export),
            ("POST", f"{key}/query", lambda k, q: (200, self.rows(self.engine.query(q["sparql"], self.known(k)), q))),
            ("GET", f"{key}/elements", lambda k, q: (200, self.rows(self.engine.elements(self.known(k), q.get("type")), q))),
            ("GET", f"{key}/chunks", self.chunks),
        ]

    def convert(self, query: dict) -> tuple[int, object]:
        key = self.engine.convert(str(query["source"]), preset=query.get("preset"))
        return 201, {"id": key, "documents": self.engine.frames(key).docs.count()}

    def export(self, key: str, query: dict) -> tuple[int, object]:
        kind = query.get("format", "json")
        if kind not in EXPORTS:
            raise Refused(400, f"format is one of {', '.join(EXPORTS)}")
        return 200, self.rows(self.engine.export(self.known(key), kind), query)

    def chunks(self, key: str, query: dict) -> tuple[int, object]:
        options = {"max_tokens": int(query.get("max_tokens", 512)), "include_headings": str(query.get("include_headings", "true")).lower() == "true"}
        return 200, self.rows(self.engine.chunks(self.known(key), **options), query)


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is bound but not yet running: call ``serve_forever``."""
    routes = Routes(engine)

    class Handler(BaseHTTPRequestHandler):
        def run(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            status, made = routes.answer(self.command, self.path, self.rfile.read(length))
            data = json.dumps(made).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = run  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
