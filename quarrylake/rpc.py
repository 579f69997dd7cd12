"""Tools over JSON-RPC: a line in, a line out. Requests without an id are notifications and get no answer."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from quarrylake import tools

PARSE_ERROR, UNKNOWN_METHOD = -32700, -32601


def answer(workspace: tools.Workspace, line: str, log: tools.ToolLog | None = None) -> dict | None:
    """The response to one line, or None for a notification or a blank line."""
    if not line.strip():
        return None
    try:
        request = json.loads(line)
        method, number = request.get("method"), request.get("id")
    except (ValueError, AttributeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not a JSON request"}}
    if "id" not in request:
        return None
    reply = lambda **body: {"jsonrpc": "2.0", "id": number} | body
    params = request.get("params") or {}
    if method == "initialize":
        return reply(result={"name": "quarrylake", "capabilities": {"tools": {}}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": tools.describe()})
    if method == "tools/call":
        done = tools.call(workspace, params.get("name", ""), params.get("arguments"), params.get("timeout"), log)
        text = done["ok"] if isinstance(done.get("ok"), str) else json.dumps(done.get("ok"), default=str) if "ok" in done else f"{done['error']}: {done['message']}"
        return reply(result={"content": [{"type": "text", "text": text}], "isError": "ok" not in done})
    return reply(error={"code": UNKNOWN_METHOD, "message": f"no method is called {method}"})


def serve(workspace: tools.Workspace, source: TextIO | None = None, sink: TextIO | None = None, log: tools.ToolLog | None = None) -> int:
    """Answer requests until the input ends; returns how many were answered."""
    log, n = log or tools.ToolLog(None), 0
    log.write("start", root=workspace.root)
    for line in source or sys.stdin:
        out = answer(workspace, line, log)
        if out is not None:
            print(json.dumps(out, default=str), file=sink or sys.stdout, flush=True)
            n += 1
    return n
