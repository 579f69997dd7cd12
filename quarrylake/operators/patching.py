"""Replacing a symbol's text in a file: reindent, splice by bytes, check, and a unified diff."""

from __future__ import annotations

import difflib
import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame

from quarrylake.functions.extract import facts_of
from quarrylake.functions.languages import ADAPTERS


def reindent(text: str, indent: str) -> str:
    """``text`` with its common leading white space replaced by ``indent``; blank lines stay blank."""
    rows = text.strip("\n").split("\n")
    leads = [r[: len(r) - len(r.lstrip())] for r in rows if r.strip()]
    common = os.path.commonprefix(leads) if leads else ""
    return "\n".join(indent + r[len(common) :] if r.strip() else "" for r in rows)


def patch_source(path: str, language: str, source: str, symbol: str, replacement: str) -> dict:
    """Status ('applied', 'not_found', 'invalid'), the new source and a unified diff (context 3)."""
    owner, _, name = symbol.replace("::", ".").rpartition(".")
    found = [f for f in facts_of(path, language, source) if f[2] == "symbol" and f[5] == name and (not owner or f[7] == owner)]
    if not found:
        return {"status": "not_found", "after": None, "diff": None}
    raw = source.encode()
    start, end = found[0][14], found[0][15]
    line = raw.rfind(b"\n", 0, start) + 1
    lead = raw[line:end].decode(errors="replace")
    indent = lead[: len(lead) - len(lead.lstrip(" \t"))]
    newline = "\r\n" if "\r\n" in source else "\n"
    text = reindent(replacement.replace("\r\n", "\n"), indent).replace("\n", newline)
    after = (raw[:line] + text.encode() + raw[end:]).decode()
    adapter = ADAPTERS[language]
    faults = adapter.faults(after)
    if faults and not (language != "python" and adapter.faults(source)):
        return {"status": f"invalid: line {faults[0]['line']}, column {faults[0]['column']}: {faults[0]['kind']}", "after": None, "diff": None, "faults": faults}
    diff = "\n".join(difflib.unified_diff(source.split("\n"), after.split("\n"), f"a/{path}", f"b/{path}", lineterm=""))
    return {"status": "applied", "after": after, "diff": diff}


def patch(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (path, symbol, replacement) of files: path, symbol, status, after, diff; each on the file as it is."""

    def run(frames):
        for pdf in frames:
            rows = [(r.path, r.symbol, *(done[k] for k in ("status", "after", "diff"))) for r in pdf.itertuples(index=False) for done in [patch_source(r.path, r.language, r.content, r.symbol, r.replacement)]]
            yield pd.DataFrame(rows, columns=["path", "symbol", "status", "after", "diff"])

    return edits.join(files.select("path", "language", "content"), "path").mapInPandas(run, "path string, symbol string, status string, after string, diff string")


def replace_file(path: str, text: str) -> None:
    """Write a file through a temporary one in its folder, so readers see the old text or the new."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(temporary, path)
