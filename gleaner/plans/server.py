"""A line-delimited JSON-RPC server over standard input and output, with the tools over stored tables."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators import links
from gleaner.operators.resilience import TTLCache
from gleaner.plans import tools

VERSION = "2024-11-05"


def _text(name: str, about: str) -> dict:
    return {name: {"type": "string", "description": about}}


def _number(name: str, about: str) -> dict:
    return {name: {"type": "integer", "minimum": 1, "description": about}}


class Server:
    """Tools over a corpus (doc_id, url, title, content) and stored pages (url, html)."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, pages: DataFrame) -> None:
        self.spark, self.corpus, self.pages, self.cache = spark, corpus, pages, TTLCache(500, 300)
        self.tools: dict[str, tuple[str, dict, Callable[[dict], Any]]] = {
            "search": ("Ranked and grounded hits", {**_text("query", "what to look for"), **_number("max_results", "20 at most")}, self._search),
            "scrape": ("The text of a stored page", {**_text("url", "its URL"), **_number("max_tokens", "budget")}, self._scrape),
            "crawl": ("Pages reached from a stored page", {**_text("url", "where to start"), **_number("max_pages", "20 at most"), **_number("max_depth", "3 at most"), **_text("instructions", "words to match")}, self._crawl),
            "extract": ("The texts of several pages", {"urls": {"type": "array", "items": {"type": "string"}}, **_text("query", "what they are about"), **_number("max_tokens", "budget")}, self._extract),
            "map": ("The links of a page", {**_text("url", "its URL"), **_number("max_urls", "100 at most")}, self._map),
            "validate": ("How sources bear on a claim", {**_text("claim", "the claim"), **_number("max_sources", "10 at most")}, self._validate),
            "docs": ("Documentation of a library", {**_text("library", "its name"), **_text("query", "what to look for"), **_number("max_tokens", "budget")}, self._docs),
            "research": ("Several searches fused", {**_text("query", "what to look for"), **_text("depth", "quick, standard or deep"), **_number("max_tokens", "budget")}, self._research),
        }

    def _frame(self, schema: str, *row: Any) -> DataFrame:
        return self.spark.createDataFrame([row], schema)

    @staticmethod
    def _rows(df: DataFrame, order: str | None = None) -> list[dict]:
        return [r.asDict(recursive=True) for r in (df.orderBy(order) if order else df).collect()]

    def _search(self, a: dict) -> Any:
        raw, n = a.get("query", ""), a.get("max_results", 10)
        key = (" ".join(raw.lower().split()), n)
        found = self.cache.get(key)
        if found is None:
            found = self._rows(tools.search(self._frame("query_id long, raw_query string, max_results int", 0, raw, n), self.corpus), "pos")
            self.cache.set(key, found)
        return {"query": raw, "result_count": len(found), "results": found}

    def _scrape(self, a: dict) -> Any:
        rows = self._rows(tools.scrape(self.pages.filter(self.pages.url == a.get("url", "")), max_tokens=a.get("max_tokens", 2000)))
        return rows[0] if rows else {"url": a.get("url", ""), "status": "error"}

    def _crawl(self, a: dict) -> Any:
        return self._rows(links.crawl(self.pages, self._frame("url string", a.get("url", "")), a.get("max_pages", 10), a.get("max_depth", 2), a.get("instructions", "")), "pos")

    def _extract(self, a: dict) -> Any:
        return self._rows(tools.extract(self.pages, self.spark.createDataFrame([(u,) for u in a.get("urls", [])], "url string"), a.get("query", ""), a.get("max_tokens", 3000)))

    def _map(self, a: dict) -> Any:
        return [r["link"] for r in self._rows(tools.map_urls(self.pages.filter(self.pages.url == a.get("url", "")), a.get("max_urls", 50)), "ord")]

    def _validate(self, a: dict) -> Any:
        summary, sources = tools.validate(self._frame("query_id long, claim string, max_sources int", 0, a.get("claim", ""), a.get("max_sources", 5)), self.corpus)
        return {**self._rows(summary)[0], "sources": self._rows(sources, "pos")}

    def _docs(self, a: dict) -> Any:
        return self._rows(tools.docs(self._frame("library string, query string", a.get("library", ""), a.get("query", "")), self.pages, max_tokens=a.get("max_tokens", 1500)))[0]

    def _research(self, a: dict) -> Any:
        return self._rows(tools.research(self._frame("query_id long, raw_query string, depth string, max_tokens int", 0, a.get("query", ""), a.get("depth", "standard"), a.get("max_tokens", 3000)), self.corpus, self.pages), "pos")

    def call(self, name: str, arguments: dict) -> dict:
        """What a tool returns, as JSON text; an unknown tool or an exception gives an error result."""
        if name not in self.tools:
            return {"isError": True, "content": [{"type": "text", "text": f"unknown tool: {name}"}]}
        try:
            made = self.tools[name][2](arguments)
        except Exception as e:  # noqa: BLE001 - a tool's failure is a result
            return {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"[:500]}]}
        return {"content": [{"type": "text", "text": json.dumps(made, ensure_ascii=False, default=str)}]}

    def handle(self, request: dict) -> dict | None:
        """The response to a request; none to a notification."""
        method, ident = request.get("method", ""), request.get("id")
        if method.startswith("notifications/"):
            return None
        if method == "initialize":
            result = {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "gleaner", "version": "0.1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p, _) in self.tools.items()]}
        elif method == "tools/call":
            p = request.get("params") or {}
            result = self.call(p.get("name", ""), p.get("arguments") or {})
        else:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"no such method: {method}"}}
        return {"jsonrpc": "2.0", "id": ident, "result": result}

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Answers requests line by line; lines that are no JSON are skipped."""
        for line in lines:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            if isinstance(request, dict) and (response := self.handle(request)) is not None:
                out.write(json.dumps(response, ensure_ascii=False) + "\n")
                out.flush()
