"""A tool server on standard input and output: JSON-RPC 2.0, one message a line.

It answers ``initialize``, ``ping``, ``tools/list`` and ``tools/call``, as clients
of the Model Context Protocol send them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from fathomer.plans.tools import Tools, as_json

PROTOCOL = "2024-11-05"
_PARSE, _REQUEST, _METHOD, _PARAMS = -32700, -32600, -32601, -32602


def _text(about: str, **more: object) -> dict:
    return {"type": "string", "description": about, **more}


def _number(about: str) -> dict:
    return {"type": "number", "description": about}


class Server:
    """The five tools of a store."""

    def __init__(self, tools: Tools, root: str = ".") -> None:
        self.tools, self.root = tools, root
        #: name: (what it does, its arguments, those that are required, the call)
        self.known: dict[str, tuple[str, dict, list[str], Callable[[dict], str]]] = {
            "index": ("Bring the index of a source tree up to date.", {"path": _text("root of the tree; default: where the server runs")}, [], self._index),
            "search": (
                "Find symbols by name or by what they do.",
                {"query": _text("a name or a description"), "mode": _text("how to search; default: hybrid", enum=["keyword", "semantic", "hybrid"]), "limit": _number("most results; default: 10")},
                ["query"],
                lambda a: as_json(self.tools.search(a["query"], a.get("mode", ""), int(a.get("limit", 10))), "rank"),
            ),
            "file_skeleton": ("The symbols of a file with their signatures and lines.", {"path": _text("path below the root")}, ["path"], lambda a: as_json(self.tools.file_skeleton(a["path"]), "start_line", "id")),
            "feature_traverse": (
                "What a symbol reaches along calls.",
                {"query": _text("name of the symbol"), "depth": _number("most calls in a row; default: 3")},
                ["query"],
                lambda a: as_json(self.tools.feature_traverse(a["query"], int(a.get("depth", 3))), "hop", "id"),
            ),
            "blast_radius": ("What calls a symbol.", {"symbol": _text("name of the symbol")}, ["symbol"], lambda a: self.tools.blast_radius_json(a["symbol"])),
        }

    def _index(self, arguments: dict) -> str:
        s = self.tools.index(arguments.get("path") or self.root)
        return f"indexed {s.files_indexed} files, skipped {s.files_skipped}, {s.symbols} symbols, {s.duration:.1f} s"

    def answer(self, line: str) -> str | None:
        """The answer to a message; None for notifications."""
        try:
            message = json.loads(line)
        except ValueError:
            return self._error(None, _PARSE, "no JSON")
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return self._error(None, _REQUEST, "no request")
        if "id" not in message:
            return None
        key, method, params = message["id"], message["method"], message.get("params") or {}
        if method == "initialize":
            return self._result(key, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "fathomer", "version": "0.1.0"}})
        if method == "ping":
            return self._result(key, {})
        if method == "tools/list":
            return self._result(key, {"tools": [{"name": name, "description": about, "inputSchema": {"type": "object", "properties": own, "required": needed}} for name, (about, own, needed, _) in self.known.items()]})
        if method == "tools/call":
            return self._call(key, params)
        return self._error(key, _METHOD, f"unknown method {method}")

    def _call(self, key: object, params: dict) -> str:
        name, arguments = params.get("name"), params.get("arguments") or {}
        if name not in self.known:
            return self._error(key, _PARAMS, f"unknown tool {name}")
        _, own, needed, call = self.known[name]
        missing = [x for x in needed if not arguments.get(x)]
        failed = f"missing: {', '.join(missing)}" if missing else ""
        if not failed:
            try:
                return self._result(key, {"content": [{"type": "text", "text": call({k: v for k, v in arguments.items() if k in own})}], "isError": False})
            except Exception as problem:  # a tool that fails must not end the server
                failed = str(problem) or type(problem).__name__
        return self._result(key, {"content": [{"type": "text", "text": failed}], "isError": True})

    def run(self, source: TextIO, out: TextIO) -> None:
        """Answer every line until the input ends."""
        for line in source:
            if line.strip() and (answer := self.answer(line)) is not None:
                out.write(answer + "\n")
                out.flush()

    @staticmethod
    def _result(key: object, result: dict) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": key, "result": result}, ensure_ascii=False)

    @staticmethod
    def _error(key: object, code: int, text: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}})
