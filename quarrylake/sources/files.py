"""Source trees as tables: folders are walked by tasks, names are tested before contents are read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.errors import UnreadableFile

IGNORED_DIRS = (
    "node_modules", "vendor", "target", "dist", "build", "out", "coverage", "venv", ".venv", "env", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".git", ".idea", ".vscode", ".turbo", ".next",
)
IGNORED_NAMES = ("poetry.lock", "Cargo.lock", "yarn.lock", "pnpm-lock.yaml", "package-lock.json")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust"}
TS_FAMILY = ("typescript", "javascript")
SCHEMA = "path string, language string, size long, content string"
#: Bytes of contents in a batch, about.
BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class ScanOptions:
    """What a scan leaves out. ``with_`` returns a changed copy."""

    max_bytes: int = 10 * 1024 * 1024
    hidden: bool = False
    follow_links: bool = False
    ignored_dirs: tuple[str, ...] = ()
    ignored_files: tuple[str, ...] = ()
    ignore_rules: tuple[str, ...] = ()
    #: Names of files in the tree whose lines are rules for the folder they are in; none: the tree's own rules don't count.
    ignore_files: tuple[str, ...] = (".gitignore", ".ignore")
    languages: tuple[str, ...] = ()

    def with_(self, **changes) -> ScanOptions:
        return replace(self, **changes)


def language_of(path: Column) -> Column:
    """The language by the lower-cased extension; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension]


def language_name(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rpartition(".")[2].lower()) if "." in name else None


def in_ignored_dir(path: Column, extra: tuple[str, ...] = ()) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, (*IGNORED_DIRS, *extra))))


def matches_glob(name: Column, pattern: str) -> Column:
    """The mini-glob: ``*suffix``, ``prefix*`` or an exact name."""
    if pattern.startswith("*"):
        return F.endswith(name, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(name, F.lit(pattern[:-1]))
    return name == pattern


_IGNORED_EXTENSION, _IGNORED_END = r"\.(lock|map|wasm|pyc)$", r"\.(min|bundle)\.js$"


def is_ignored_file(path: Column, extra: tuple[str, ...] = ()) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    out = name.isin(*IGNORED_NAMES) | F.lower(name).rlike(_IGNORED_EXTENSION) | name.rlike(_IGNORED_END)
    for pattern in extra:
        out = out | matches_glob(name, pattern)
    return out


def is_test_file(path: Column, like: Column) -> Column:
    """Whether a file's name says test or spec and its extension is that of ``like`` (any, if that has none)."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    return name.rlike("test|spec") & ((extension(like) == "") | (extension(path) == extension(like)))


def ignore_rule(rule: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, negated) of one line of an ignore file."""
    line = rule.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    anchored = "/" in line.rstrip("/")[:-1] or line.startswith("/")
    only_dir = line.endswith("/")
    body, k, line = "", 0, line.strip("/")
    while k < len(line):
        if line.startswith("**/", k):
            body, k = body + "(?:.*/)?", k + 3
        elif line.startswith("**", k):
            body, k = body + ".*", k + 2
        else:
            c = line[k]
            body, k = body + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".+()|^${}[]\\" else c), k + 1
    return ("^" if anchored else "(?:^|/)") + body + ("/" if only_dir else "(?:/|$)"), negated


def is_ignored_by(path: Column, rules: tuple[str, ...]) -> Column:
    """Whether the last of the rules that matches excludes the path."""
    out = F.lit(False)
    for parsed in filter(None, map(ignore_rule, rules)):
        out = F.when(path.rlike(parsed[0]), F.lit(not parsed[1])).otherwise(out)
    return out


class Walker:
    """A folder's files that the options leave in, in order of name; ignored folders are never entered.

    Rules are (folder, regular expression, negated), outer folders' first; of those that match a path the
    last decides, and what lies in an excluded folder stays out.
    """

    def __init__(self, root: str, options: ScanOptions):
        self.root, self.options = root.removeprefix("file://").rstrip("/") or "/", options
        self.first = [("", *p) for p in map(ignore_rule, options.ignore_rules) if p]

    def excluded(self, path: str, is_dir: bool, rules: list[tuple[str, str, bool]]) -> bool:
        name = path.rsplit("/", 1)[-1]
        o = self.options
        if name.startswith(".") and not o.hidden:
            return True
        if is_dir and (name in IGNORED_DIRS or name in o.ignored_dirs):
            return True
        if not is_dir and (name in IGNORED_NAMES or re.search(_IGNORED_EXTENSION, name.lower()) or re.search(_IGNORED_END, name) or any(self._glob(name, p) for p in o.ignored_files)):
            return True
        out = False
        for folder, pattern, negated in rules:
            if not folder or path.startswith(folder + "/"):
                if re.search(pattern, path[len(folder) + 1 if folder else 0 :] + "/" * is_dir):
                    out = not negated
        return out

    @staticmethod
    def _glob(name: str, pattern: str) -> bool:
        return name.endswith(pattern[1:]) if pattern.startswith("*") else name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern

    def rules_of(self, folder: str) -> list[tuple[str, str, bool]]:
        """The rules that the folder's own ignore files add."""
        out = []
        for name in self.options.ignore_files:
            try:
                with open(os.path.join(self.root, folder, name), encoding="utf-8", errors="replace") as f:
                    out += [(folder, *p) for p in map(ignore_rule, f.read().splitlines()) if p]
            except OSError:
                continue
        return out

    def entries(self, folder: str, rules: list) -> Iterator[tuple[str, bool, int]]:
        """(path, is folder, size) of what is left in one folder."""
        try:
            found = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_symlink() and not self.options.follow_links:
                    continue
                is_dir = e.is_dir()
                if not self.excluded(path, is_dir, rules):
                    yield path, is_dir, 0 if is_dir else e.stat().st_size
            except OSError:
                continue

    def walk(self, folder: str, rules: list, seen: frozenset = frozenset()) -> Iterator[tuple[str, int]]:
        """(path, size) of the files at and under a folder. A folder that links lead back to isn't entered again."""
        rules = rules + self.rules_of(folder)
        here = os.path.realpath(os.path.join(self.root, folder))
        if here in seen:
            return
        for path, is_dir, size in self.entries(folder, rules):
            if is_dir:
                yield from self.walk(path, rules, seen | {here})
            elif size <= self.options.max_bytes and (not self.options.languages or language_name(path) in self.options.languages):
                yield path, size


def is_binary_head(head: bytes) -> bool:
    """Whether the first bytes of a file hold a NUL, or UTF-8 that is wrong before a cut-off tail."""
    if b"\x00" in head:
        return True
    try:
        head.decode()
    except UnicodeDecodeError as e:
        return not (e.reason == "unexpected end of data" and e.end == len(head))
    return False


def read_text(path: str) -> str:
    """A whole file as text, for a point query: raises where a scan would leave it out."""
    try:
        with open(path.removeprefix("file://"), "rb") as f:
            return f.read().decode()
    except OSError as e:
        raise UnreadableFile(path, e.strerror or str(e)) from e
    except UnicodeDecodeError as e:
        raise UnreadableFile(path, f"not UTF-8 at byte {e.start}") from e


def scan_files(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, language, size, content) of the text files under ``root``, paths relative to it.

    The folder must be visible to all executors under that name. The driver lists the root alone; each
    folder in it is walked by a task, which reads what names, sizes and ignore files leave. Binary files,
    invalid UTF-8 and unreadable files are left out. A root that is a file is a scan of that file alone,
    whatever its name and size.
    """
    walker = Walker(root, options)
    if os.path.isfile(walker.root):
        folder, name = os.path.split(walker.root)
        walker = Walker(folder, options)
        parts = [(name, False)]
    else:
        rules = walker.first + walker.rules_of("")
        parts = [(p, d) for p, d, size in walker.entries("", rules) if d or size <= options.max_bytes and (not options.languages or language_name(p) in options.languages)]

    def read(batches):
        for batch in batches:
            rows, held = [], 0
            for part, is_dir in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = walker.walk(part, walker.first + walker.rules_of("")) if is_dir else [(part, -1)]
                for path, _ in found:
                    try:
                        with open(os.path.join(walker.root, path), "rb") as f:
                            raw = f.read(1024)
                            if is_binary_head(raw):
                                continue
                            raw += f.read()
                        rows.append((path.replace("\\", "/"), language_name(path), len(raw), raw.decode()))
                    except (OSError, UnicodeDecodeError):
                        continue
                    held += len(raw)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    listed = spark.createDataFrame(parts, "part string, is_dir boolean")
    return listed.repartition(max(1, min(len(parts), 4096))).mapInArrow(read, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "language", "size", "content"])
