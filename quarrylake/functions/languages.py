"""Languages behind one surface: what each file is read with, by its path or by name."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

from quarrylake.errors import UnsupportedLanguage, snippet
from quarrylake.functions import extract as X
from quarrylake.sources.files import LANGUAGES, language_name


@dataclass(frozen=True)
class Adapter:
    """One language's reading of a source."""

    name: str
    extensions: tuple[str, ...]
    separator: str = "."

    def symbols(self, source: str) -> list[dict]:
        """All symbols in order of place, members with their container."""
        if self.name == "python":
            return X.python_symbols(source) or X.indented_symbols(source)
        return X.structural_symbols(source, self.name)

    def names(self, source: str) -> list[str]:
        return [f"{s['container']}{self.separator}{s['name']}" if s["container"] else s["name"] for s in self.symbols(source)]

    def locate(self, source: str, query: str) -> dict | None:
        """A name or ``Container.member``: the container's member, else a top-level symbol, else any member."""
        owner, _, name = re.sub("::", ".", query).rpartition(".")
        found = [s for s in self.symbols(source) if s["name"] == name]
        if owner:
            return next((s for s in found if s["container"] == owner.rpartition(".")[2]), None)
        return next((s for s in found if not s["container"]), found[0] if found else None)

    def inside(self, source: str, kind: str, outer: dict | None = None) -> list[dict]:
        """Symbols of a kind that lie within another, at any depth, in order."""
        return [s for s in self.symbols(source) if s["kind"] == kind and (outer is None or outer["start_byte"] <= s["start_byte"] and s["end_byte"] <= outer["end_byte"] and s is not outer)]

    def imports(self, source: str) -> list[tuple]:
        return list(X.imports(source, self.name))

    def references(self, source: str, query: str) -> list[str]:
        return self._facts(source, query, "ref")

    def calls(self, source: str, query: str) -> list[str]:
        return self._facts(source, query, "call")

    def _facts(self, source: str, query: str, fact: str) -> list[str]:
        at = self.locate(source, query)
        rows = X.facts_of("", self.name, source)
        number = next((r[3] for r in rows if at and r[2] == "symbol" and r[14] == at["start_byte"] and r[5] == at["name"]), None)
        return [r[5] for r in rows if r[2] == fact and r[4] == number and number is not None]

    def faults(self, source: str) -> list[dict]:
        """What doesn't parse: line, column, kind and the text there. Of what lies in a fault only the fault is told."""
        if self.name == "python":
            try:
                ast.parse(source)
            except SyntaxError as e:
                row = (source.split("\n") + [""])[max(0, (e.lineno or 1) - 1)]
                return [{"line": e.lineno or 1, "column": e.offset or 1, "kind": e.msg, "snippet": snippet(row.encode(), max(0, (e.offset or 1) - 1), len(row.encode()))}]
            except ValueError as e:
                return [{"line": 1, "column": 1, "kind": str(e), "snippet": ""}]
            return []
        return list(self._brackets(source))

    def _brackets(self, source: str) -> Iterator[dict]:
        masked, lines = X.blank(source, self.name), X._Lines(source)
        pairs, opened = {")": "(", "]": "[", "}": "{"}, []

        def fault(k: int, kind: str) -> dict:
            line = lines.number(k)
            return {"line": line, "column": k - lines.starts[line - 1] + 1, "kind": kind, "snippet": snippet(source[k : k + 60].encode(), 0, 60)}

        for m in re.finditer(r"[()\[\]{}]", masked):
            c = m[0]
            if c in "([{":
                opened.append((c, m.start()))
            elif opened and opened[-1][0] == pairs[c]:
                opened.pop()
            else:
                yield fault(m.start(), f"nothing open for {c}")
                return
        if opened:
            yield fault(opened[0][1], f"{opened[0][0]} is never closed")


def _of(name: str, separator: str = ".") -> Adapter:
    return Adapter(name, tuple(e for e, n in LANGUAGES.items() if n == name), separator)


ADAPTERS = {a.name: a for a in (_of("typescript"), _of("javascript"), _of("python"), _of("go"), _of("rust", "::"))}


def for_language(name: str) -> Adapter:
    if name.lower() not in ADAPTERS:
        raise UnsupportedLanguage(name)
    return ADAPTERS[name.lower()]


def for_path(path: str) -> Adapter:
    name = language_name(path)
    if name is None:
        raise UnsupportedLanguage(path)
    return ADAPTERS[name]
