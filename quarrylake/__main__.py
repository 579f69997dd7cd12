"""The command line: ``python -m quarrylake COMMAND``, one command for each tool, the log and the server."""

from __future__ import annotations

import argparse
import json
import os
import sys

from quarrylake import rpc, tools
from quarrylake.operators.patching import replace_file
from quarrylake.sources import events


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylake")
    p.add_argument("--root", default=".", help="the source tree")
    p.add_argument("--out", help="a file for the answer, in place of standard output")
    p.add_argument("--timeout", type=float, default=600.0)
    p.add_argument("--log", help="a file of JSON lines about calls")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("slice", help="path:symbol[,symbol]")
    c.add_argument("target")
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--budget", type=int)
    c.add_argument("--unified", action="store_true")
    sub.add_parser("diff", help="slices of what a working tree changed").add_argument("--staged", action="store_true")
    sub.add_parser("stats", help="tokens by file").add_argument("--deep", action="store_true")
    sub.add_parser("overview", help="symbols of all files").add_argument("--budget", type=int)
    c = sub.add_parser("patch", help="path:symbol, with the new text on standard input")
    c.add_argument("target")
    c.add_argument("--dry", action="store_true")
    sub.add_parser("tests", help="path:symbol: runner, stand-ins, template, fixtures").add_argument("target")
    c = sub.add_parser("route", help="the handler of a route")
    c.add_argument("method")
    c.add_argument("route")
    c = sub.add_parser("metrics", help="the telemetry log")
    c.add_argument("--format", choices=("text", "json"), default="text")
    c.add_argument("--path")
    sub.add_parser("clear", help="empty the telemetry log").add_argument("--path")
    sub.add_parser("list", help="the tools and their arguments")
    sub.add_parser("serve", help="tools as JSON-RPC on standard input and output")
    return p


def arguments(a: argparse.Namespace, text: str = "") -> dict:
    """A parsed command as its tool's arguments."""
    skip = {"root", "out", "timeout", "log", "command", "target"}
    out = {k: v for k, v in vars(a).items() if k not in skip and v is not None}
    if "target" in a:
        both = tools.parse_target(a.target)
        if both is None:
            raise SystemExit(f"{a.target} is not path:symbol")
        out |= {"path": both[0], "symbols" if a.command == "slice" else "symbol": both[1]}
    return out | ({"text": text} if a.command == "patch" else {})


def shown(value) -> str:
    """An answer as text: Markdown where there is some, else JSON."""
    if isinstance(value, str):
        return value
    rows = value if isinstance(value, list) else [value]
    marked = [r["markdown"] for r in rows if isinstance(r, dict) and r.get("markdown")]
    return "\n---\n\n".join(marked) if marked else json.dumps(value, indent=2, default=str)


def main(argv: list[str] | None = None, spark=None, text: str | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        return put(json.dumps(tools.describe(), indent=2), a.out)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "clear":
        events.clear_events(spark, a.path or events.log_path())
        return 0
    workspace, log = tools.Workspace(spark, os.path.abspath(a.root)), tools.ToolLog(a.log)
    if a.command == "serve":
        rpc.serve(workspace, log=log)
        return 0
    done = tools.call(workspace, a.command, arguments(a, text if text is not None else sys.stdin.read() if a.command == "patch" else ""), a.timeout, log)
    if "ok" not in done:
        print(f"{done['error']}: {done['message']}", file=sys.stderr)
        return 1
    return put(shown(done["ok"]), a.out)


def put(text: str, path: str | None) -> int:
    if path:
        replace_file(path, text if text.endswith("\n") else text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
