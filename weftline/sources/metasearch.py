"""Live sources as Spark data sources: metasearch responses and pages.  Network access happens on executors only when read."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = "request_id string, position int, url string, title string, snippet string, engine string, engines array<string>, score double, category string"


def parse_response(request_id: str, body: str) -> Iterator[tuple]:
    """Rows of one JSON response; unknown fields are ignored, missing ones are empty."""
    for k, x in enumerate(json.loads(body).get("results") or [], 1):
        yield (request_id, k, x.get("url") or "", x.get("title") or "", x.get("content") or "", x.get("engine") or "", list(x.get("engines") or []), float(x.get("score") or 0.0), x.get("category") or "")


def _get(url: str, timeout: float, headers: dict[str, str]) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as response:
        if response.status != 200:
            raise OSError(f"status {response.status}")
        return response.read(5 << 20).decode("utf-8", "replace")


class _Request(InputPartition):
    def __init__(self, request_id: str, url: str):
        super().__init__(request_id)
        self.request_id, self.url = request_id, url


class MetasearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, float, dict[str, str]], str] = _get):
        self.requests = json.loads(options.get("requests", "[]"))
        self.timeout = float(options.get("timeout", "10"))
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        return [_Request(r["request_id"], r["url"]) for r in self.requests]

    def read(self, partition: _Request) -> Iterator[tuple]:
        yield from parse_response(partition.request_id, self.fetch(partition.url, self.timeout, {"Accept": "application/json"}))


class MetasearchSource(DataSource):
    """``spark.read.format("metasearch").option("requests", json)``: a list of {request_id, url}."""

    @classmethod
    def name(cls) -> str:
        return "metasearch"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return MetasearchReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, float, dict[str, str]], str] = _get):
        self.urls = json.loads(options.get("urls", "[]"))
        self.timeout = float(options.get("timeout", "10"))
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        return [_Request(str(k), u) for k, u in enumerate(self.urls)]

    def read(self, partition: _Request) -> Iterator[tuple]:
        try:
            yield (int(partition.request_id), partition.url, self.fetch(partition.url, self.timeout, {"Accept": "text/html"}), None)
        except (OSError, ValueError) as e:
            yield (int(partition.request_id), partition.url, None, str(e))


class PageSource(DataSource):
    """``spark.read.format("pages").option("urls", json)``; a failed fetch is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page_id long, url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def _get_any(url: str, timeout: float, headers: dict[str, str]) -> tuple[int, str]:
    """(status, text) for any status."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as response:
            return response.status, response.read(5 << 20).decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


class RobotsReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, float, dict[str, str]], tuple[int, str]] = _get_any):
        self.hosts = json.loads(options.get("hosts", "[]"))
        self.timeout = float(options.get("timeout", "10"))
        self.agent = options.get("agent", "weftline")
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        return [_Request(h, f"https://{h}/robots.txt") for h in self.hosts]

    def read(self, partition: _Request) -> Iterator[tuple]:
        try:
            status, body = self.fetch(partition.url, self.timeout, {"User-Agent": self.agent})
        except (OSError, ValueError):
            status, body = None, None
        yield (partition.request_id, status, body)


class RobotsSource(DataSource):
    """``spark.read.format("robots").option("hosts", json)``: a row a host; a failed fetch has no status."""

    @classmethod
    def name(cls) -> str:
        return "robots"

    def schema(self) -> str:
        return "host string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return RobotsReader(self.options)


def request_for(base: str, **parameters: str) -> str:
    return f"{base}/search?{urllib.parse.urlencode(sorted(parameters.items()))}"
