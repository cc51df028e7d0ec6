"""Stand-ins for the services that the engine talks to: a documents endpoint and a chat-completion endpoint.

They run in a thread of the driver and answer over HTTP, so queries take the way that real ones take.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from tarn.operators.answering import first_excerpt_client


def serve(spark: SparkSession, answer: Callable[[str, bytes], tuple[int, dict]]) -> str:
    """The address of a server that answers a path and a body with a status and a JSON object, as long as the driver lives."""

    class Handler(BaseHTTPRequestHandler):
        def _respond(self) -> None:
            status, content = answer(self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(content).encode())

        do_GET = do_POST = _respond

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((spark.conf.get("spark.driver.host", "127.0.0.1"), 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://{server.server_address[0]}:{server.server_port}"


def documents_endpoint(spark: SparkSession, path: str) -> str:
    """``GET /documents?limit=n&offset=k`` over the documents of a Parquet table, a page read from it at a time."""
    table = ds.dataset(path)

    def answer(target: str, _: bytes) -> tuple[int, dict]:
        asked = {name: int(values[0]) for name, values in parse_qs(urlsplit(target).query).items()}
        total = table.count_rows()
        places = list(range(min(asked["offset"], total), min(asked["offset"] + asked["limit"], total)))
        return 200, {"items": table.take(places, columns=["url", "title", "text", "source"]).to_pylist() if places else []}

    return serve(spark, answer)


def model_endpoint(spark: SparkSession, refused: int = 2) -> str:
    """Chat completions by the stand-in model; the first ``refused`` calls are told to come again."""
    complete, calls = first_excerpt_client(), []

    def answer(_: str, body: bytes) -> tuple[int, dict]:
        calls.append(True)
        if len(calls) <= refused:
            return 429, {}
        said = {m["role"]: m["content"] for m in json.loads(body)["messages"]}
        return 200, json.loads(complete(said["system"], said["user"]))

    return serve(spark, answer)
