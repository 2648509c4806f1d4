"""The HTTP service over ``api.Engine`` (SRV-1): status, skip, what plays, and the next playlist."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from cadenza.plans.api import Engine

#: The request that is prepared ahead and played.
REQUEST = {"limit": 60, "ann_pool": 800, "alpha": 0.7, "weight": 0.8}


class Service:
    """Routes of the service. ``queue`` gives the player's response as a DataFrame, whenever it is asked.

    Requests that change state take turns. The next playlist is made in the background, so
    playing answers with the one that is ready.
    """

    def __init__(self, engine: Engine, queue: Callable[[], DataFrame], options: dict = REQUEST) -> None:
        self.engine, self.queue, self.options = engine, queue, options
        self.turn = threading.RLock()
        self.preparing: threading.Thread | None = None
        self.routes = {("GET", "/api/status"): self.status, ("POST", "/track/skip"): self.skip, ("GET", "/music/play"): self.now, ("POST", "/music/play"): self.play}

    def answer(self, method: str, path: str) -> tuple[int, str, str]:
        """Status, content type and body of a request."""
        known = self.routes.get((method, path.partition("?")[0]))
        return known() if known else (404, "text/plain", "Not Found")

    def status(self) -> tuple[int, str, str]:
        return 200, "text/plain", "OK"

    def _json(self, value: dict) -> tuple[int, str, str]:
        return 200, "application/json", json.dumps(value)

    def skip(self) -> tuple[int, str, str]:
        with self.turn:
            if self.engine.skip_current(self.queue()) == "not found":
                return 404, "text/plain", "No track found"
        return self._json({"success": True})

    def now(self) -> tuple[int, str, str]:
        item = self.engine.now_playing(self.queue()).first()
        if item is None:
            return 404, "text/plain", "No track found"
        return self._json({"uri": item.uri, "artists": list(item.artists or [])})

    def play(self) -> tuple[int, str, str]:
        if self.preparing is not None:
            self.preparing.join()
        with self.turn:
            playing = self.engine.play_prepared(**self.options)
        self.prepare()
        rows = playing.orderBy("pos").select("uri", "name", "artists", "album").collect()
        return self._json({"success": True, "tracks": [r.asDict() for r in rows]})

    def prepare(self) -> None:
        def run() -> None:
            with self.turn:
                self.engine.prepare_next(**self.options)

        self.preparing = threading.Thread(target=run, daemon=True)
        self.preparing.start()

    def serve(self, port: int = 3000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
        """A server that answers in threads of its own until ``shutdown``."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _reply(self) -> None:
                self.rfile.read(int(self.headers.get("Content-Length") or 0))
                try:
                    status, kind, body = service.answer(self.command, self.path)
                except Exception as error:  # noqa: BLE001  one failed request doesn't end the service
                    status, kind, body = 500, "text/plain", type(error).__name__
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PUT = do_DELETE = _reply

            def log_message(self, *args: object) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
