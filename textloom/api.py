"""The engine over HTTP: a server for search and completion, a client for it, and options from files and the environment."""

from __future__ import annotations

import dataclasses
import json
import os
import threading
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError, URLError
from urllib.parse import parse_qs, urlencode, urlsplit
from urllib.request import urlopen

from pyspark.sql import DataFrame

from textloom.functions import exact
from textloom.operators import search as se
from textloom.operators import standard as st
from textloom.operators.index import Index


def options(kind: type, path: str | None = None, prefix: str = "TEXTLOOM_", env: Mapping[str, str] = os.environ):
    """An options dataclass: defaults, then the object named like it in a JSON file, then variables like PREFIX_K1. Unknown names in the file are errors."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    values: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f).get(kind.__name__, {})
        if unknown := set(values) - set(fields):
            raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    for name in fields:
        if (said := env.get(prefix + name.upper())) is not None:
            values[name] = said
    return kind(**{n: type(fields[n].default)(v) for n, v in values.items()})


class Engine:
    """What the server asks: search(query, top, correct) and autocomplete(prefix, top)."""

    def __init__(self, search: Callable[[str, int, bool], se.Response], autocomplete: Callable[[str, int], DataFrame]):
        self.search, self.autocomplete = search, autocomplete


def own_engine(current: Callable[[], Index | None]) -> Engine:
    """The engine over an index, or over what a Refresher holds at the moment."""

    def search(query: str, top: int, correct: bool) -> se.Response:
        if (index := current()) is None:
            raise se.IndexNotReady("no index yet")
        return se.search(index, query, top, correct)

    return Engine(search, lambda prefix, top: se.autocomplete(current(), prefix, top))


def standard_engine(pages: DataFrame, titles: DataFrame) -> Engine:
    """The second engine over pages (doc_id, url, title, content) and titles (title)."""
    return Engine(lambda query, top, correct: st.search(pages, query, top, correct), lambda prefix, top: st.autocomplete(titles, prefix, top))


def _answer(engine: Engine, path: str, asked: dict[str, str]) -> dict:
    if path == "/search":
        r = engine.search(asked.get("q", ""), int(asked.get("top", 20)), asked.get("correct", "true").lower() != "false")
        said = {"original": r.did_you_mean[0], "corrected": r.did_you_mean[1]} if r.did_you_mean else None
        return {"query": r.query, "results": [{"url": x.url, "title": x.title, "preview": x.preview, "score": x.score} for x in r.results], "didYouMean": said}
    rows = engine.autocomplete(asked.get("prefix", ""), int(asked.get("top", 10))).orderBy("ord").collect()
    return {"prefix": asked.get("prefix", ""), "suggestions": [{"text": x.text, "isCorrection": x.is_correction} for x in rows]}


def serve(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """GET /search?q&top&correct and GET /autocomplete?prefix&top, as JSON. 400 for a blank or wrong request, 503 without an index. Runs until shutdown()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            try:
                if at.path not in ("/search", "/autocomplete"):
                    raise FileNotFoundError(at.path)
                status, body = 200, _answer(engine, at.path, {k: v[-1] for k, v in parse_qs(at.query, keep_blank_values=True).items()})
            except ValueError as e:
                status, body = 400, {"error": str(e)}
            except FileNotFoundError:
                status, body = 404, {"error": "no such path"}
            except se.IndexNotReady as e:
                status, body = 503, {"error": str(e)}
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Client:
    """Of a server at base: decoded answers, or None where it says anything but yes."""

    def __init__(self, base: str, timeout_s: float = 30.0):
        self.base, self.timeout_s = base.rstrip("/"), timeout_s

    def _get(self, path: str, **asked) -> dict | None:
        try:
            with urlopen(f"{self.base}{path}?{urlencode(asked)}", timeout=self.timeout_s) as r:
                return json.loads(r.read())
        except (HTTPError, URLError, TimeoutError):
            return None

    def search(self, query: str, top: int = 20, correct: bool = True) -> dict | None:
        return self._get("/search", q=query, top=top, correct=str(correct).lower())

    def autocomplete(self, prefix: str, top: int = 10) -> dict | None:
        return self._get("/autocomplete", prefix=prefix, top=top)


@dataclasses.dataclass
class SearchBox:
    """What a search field does: asks for completions once the typing has paused, and takes one of them into the text.

    now() is a clock in seconds; the owner calls typed() for each change and poll() from time to time.
    """

    clients: dict[str, Client]
    engine: str
    now: Callable[[], float]
    pause_s: float = 0.2
    least: int = 2
    text: str = ""
    _since: float | None = None

    def typed(self, text: str) -> None:
        self.text, self._since = text, self.now()

    def poll(self) -> list[str] | None:
        """Suggestions for the last word, if it has stood long enough and is long enough; once for each change."""
        word = self.text.split(" ")[-1]
        if self._since is None or self.now() - self._since < self.pause_s:
            return None
        self._since = None
        if len(word.strip()) < self.least:
            return []
        found = self.clients[self.engine].autocomplete(word, 10)
        return [s["text"] for s in found["suggestions"]] if found else []

    def pick(self, suggestion: str) -> str:
        """A suggestion of several words replaces the text, another one the last word."""
        self.text = suggestion if " " in suggestion else self.text[: len(self.text) - len(self.text.split(" ")[-1])] + suggestion
        return self.text

    def submit(self) -> dict | None:
        return self.clients[self.engine].search(self.text, 20) if exact.fold(self.text).strip() else None
