"""A small HTTP front: ``/<prefix>/<dataset>.<extension>?<constraint expression>``."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

from funcframe import encoders
from funcframe.model import ModelError
from funcframe.sources.fdml import Catalog


def respond(catalog: Catalog, path: str, query: str = "", accept: str = "") -> tuple[int, str, list]:
    """(status, media type, parts of the body) of a request."""
    name, dot, ext = path.strip("/").rpartition(".")
    if not dot or ext not in encoders.BY_EXTENSION:
        name, ext = path.strip("/"), "meta"
    found = catalog.find(name)
    if found is None:
        listed = catalog if not name else catalog.find_catalog(name)
        if listed is None:
            return 404, "text/plain", [f"Dataset not found: {name}"]
        if "json" in accept:
            return 200, "application/json", [json.dumps(listed.listing())]
        return 200, "text/html", [encoders.html_catalog(listed.listing())]
    media, encode = encoders.BY_EXTENSION[ext]
    try:
        return 200, media, encode(found.query(unquote(query)))
    except ModelError as e:
        return 400, "text/plain", [str(e)]


def server(catalog: Catalog, port: int = 8080, prefix: str = "/dap2") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            if not url.path.startswith(prefix):
                status, media, body = (200, "text/html", ["<a href='" + prefix + "'>Datasets</a>"]) if url.path == "/" else (404, "text/plain", ["Not found"])
            else:
                try:
                    status, media, body = respond(catalog, url.path[len(prefix) :], url.query, self.headers.get("Accept", ""))
                except Exception as e:  # noqa: BLE001
                    status, media, body = 500, "text/plain", [str(e)]
            self.send_response(status)
            self.send_header("Content-Type", media)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            for part in body:
                self.wfile.write(part if isinstance(part, bytes) else part.encode())

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
