"""What a point query can end with. Tables of queries have a status column instead; nothing in them raises."""

from __future__ import annotations


class QuarryError(Exception):
    """The base of all; ``status`` is what a table's row would say."""

    status = "error"


class UnreadableFile(QuarryError):
    status = "unreadable"

    def __init__(self, path: str, reason: str):
        super().__init__(f"{path} can't be read: {reason}")


class UnsupportedLanguage(QuarryError):
    status = "unsupported_language"

    def __init__(self, path: str):
        extension = path.rsplit("/", 1)[-1].rpartition(".")[2] if "." in path.rsplit("/", 1)[-1] else ""
        super().__init__(f"no language is known for {path}" + (f" (extension {extension})" if extension else ""))


class UnknownSymbol(QuarryError):
    status = "not_found"

    def __init__(self, symbol: str, path: str, names: list[str]):
        near = nearest(symbol, names)
        super().__init__(f"{path} has no symbol {symbol}." + (f" Is {near} meant?" if near else "") + (f" It has: {', '.join(names)}" if names else ""))
        self.suggestion = near


class InvalidPatch(QuarryError):
    status = "invalid"

    def __init__(self, path: str, faults: list[dict]):
        super().__init__(f"{path} would not parse:\n" + fault_lines(faults))
        self.faults = faults


class TimedOut(QuarryError):
    status = "timeout"

    def __init__(self, tool: str, seconds: float):
        super().__init__(f"{tool} was stopped after {seconds:g} s")


class NoRoute(QuarryError):
    status = "not_found"

    def __init__(self, method: str, route: str):
        super().__init__(f"no handler is declared for {method.upper()} {route}")


def fault_lines(faults: list[dict]) -> str:
    """A line for each fault: where it is, what, and the text there."""
    return "\n".join(f"  line {f['line']}, column {f['column']}: {f['kind']}, at {f['snippet']!r}" for f in faults)


def snippet(source: bytes, begin: int, end: int, most: int = 50) -> str:
    """The first line of a byte range, at most ``most`` bytes of it, whole characters only."""
    return source[begin : min(end, begin + most)].decode("utf-8", errors="ignore").split("\n")[0].strip()


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest(symbol: str, names: list[str], distance: int = 2) -> str | None:
    """The first name that equals the symbol but for case, begins it or begins with it, or is few edits away."""
    want = symbol.lower()
    for name in names:
        have = name.rsplit(".", 1)[-1].lower()
        if have == want or have.startswith(want) or want.startswith(have) or edit_distance(want, have) <= distance:
            return name
    return None
