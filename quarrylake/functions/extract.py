"""Facts about source files: symbols, what they mention and call, imports and re-exports.

Python is parsed with the standard library; it and the other languages have a tolerant structural
scanner (declarations by pattern, bodies by braces outside strings and comments), which also serves
files that don't parse. One pass over the files gives all facts as one table.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, language string, fact string, ord long, symbol_ord long, name string, kind string, container string, receiver string, "
    "specifier string, imported string, level int, start_line long, end_line long, start_byte long, end_byte long, signature string, body string, doc string"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_IDENT = r"[A-Za-z_$][\w$]*"
_NOISE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_RUST_NOISE = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""", re.S)
_MOD = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
_DECLARATIONS = {
    "typescript": [
        (re.compile(rf"^([ \t]*){_MOD}(function\*?|class|interface|enum)\s+({_IDENT})", re.M), None),
        (re.compile(rf"^([ \t]*){_MOD}(type)\s+({_IDENT})[^=\n]*=", re.M), None),
        (re.compile(rf"^([ \t]*){_MOD}(const|let|var)\s+({_IDENT})[^=\n]*=\s*(?:async\s*)?(?:\(|function\b|{_IDENT}\s*=>|(?:React\.)?(?:forwardRef|memo)\b)", re.M), "function"),
    ],
    "go": [(re.compile(rf"^()(func)\s+({_IDENT})", re.M), "function"), (re.compile(rf"^()(type)\s+({_IDENT})", re.M), None)],
    "rust": [(re.compile(rf"^([ \t]*)(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern\s+\"C\")\s+)*(fn|struct|enum|trait|type)\s+({_IDENT})", re.M), None)],
}
_DECLARATIONS["javascript"] = _DECLARATIONS["typescript"]
_METHOD = re.compile(rf"^([ \t]+)(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*({_IDENT})\s*(?:<[^>\n]*>)?\(", re.M)
_GO_METHOD = re.compile(rf"^func\s+\(\s*(?:{_IDENT}\s+)?\*?({_IDENT})(?:\[[^\]]*\])?\s*\)\s*({_IDENT})", re.M)
_IMPL = re.compile(rf"^[ \t]*impl(?:<[^>{{]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_IDENT})", re.M)
#: An identifier is tried from its first letter only and never in part, as what follows it can't follow a part.
_CALL = re.compile(rf"(?<![A-Za-z_$])(?:({_IDENT}+|\bself|\bthis)\s*(?:\.|::)\s*)?({_IDENT}+)\s*(?:::<[^>]*>)?\(")
_TYPE = re.compile(r"\b([A-Z]\w*)\b")
_WORDS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "match", "loop", "new", "super", "constructor", "await", "typeof", "else", "def", "class", "and", "or", "not", "in", "is", "lambda", "print"}
#: Capitalised names that a language or its libraries give, by language; they are no references.
BUILTINS = {
    "typescript": frozenset(
        "Array ArrayBuffer Awaited BigInt Boolean Buffer ConstructorParameters DataView Date Error EvalError Exclude Extract Function Infinity InstanceType Int8Array Intl Iterable Iterator JSON Map Math NaN NonNullable "
        "Number Object Omit Parameters Partial Pick Promise Proxy RangeError Readonly ReadonlyArray Record ReferenceError Reflect RegExp Required ReturnType Set String Symbol SyntaxError TypeError URL Uint8Array WeakMap WeakSet".split()
    ),
    "python": frozenset(
        "Any Annotated ArithmeticError AssertionError AttributeError BaseException Callable ClassVar Counter DefaultDict Deque Dict Ellipsis Enum Exception False Final FrozenSet Generator Generic ImportError IndexError "
        "Iterable Iterator KeyError List Literal LookupError Mapping NamedTuple None NotImplementedError OSError Optional OrderedDict Path Protocol RuntimeError Self Sequence Set StopIteration Tuple True Type TypeError TypeVar TypedDict Union ValueError".split()
    ),
    "go": frozenset("Context Duration Error Mutex Once Reader RWMutex String Time WaitGroup Writer".split()),
    "rust": frozenset(
        "Arc AsRef Box BTreeMap Cell Clone Copy Cow Debug Default Deref Display Drop Eq Err Error Fn FnMut FnOnce From FromStr Hash HashMap HashSet Into IntoIterator Iterator Mutex None Ok Option Ord PartialEq PartialOrd "
        "PathBuf Pin Rc RefCell Result RwLock Self Send Some String Sync ToString Vec".split()
    ),
}
BUILTINS["javascript"] = BUILTINS["typescript"]


def blank(source: str, language: str) -> str:
    """The source with strings and comments replaced by spaces of the same length."""
    return (_RUST_NOISE if language == "rust" else _NOISE).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_STRUCTURE = re.compile(r"[()\[\]{};\n]")


def block_end(masked: str, at: int) -> int:
    """Where the declaration at ``at`` ends: its closing brace, or its first ; or line end before any brace."""
    depth = parens = 0
    for m in _STRUCTURE.finditer(masked, at):
        k, c = m.start(), m[0]
        if c in "([":
            parens += 1
        elif c in ")]":
            parens -= 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and parens <= 0:
                return k + 1
            if depth < 0:
                return k
        elif depth == 0 and parens <= 0:
            if c == ";":
                return k + 1
            if c == "\n" and re.match(r"\s*(\n|$|[\w@#])", masked[k + 1 : k + 200]) and not masked[max(at, k - 200) : k].rstrip().endswith(("=", "|", "&", ",", "=>", "where")):
                return k
    return len(masked)


class _Lines:
    """Line numbers and byte offsets of character offsets, from offsets of line starts taken once."""

    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.source, self.ascii = source, source.isascii()
        self.bytes = [0]
        for row in () if self.ascii else source.split("\n"):
            self.bytes.append(self.bytes[-1] + len(row.encode()) + 1)

    def number(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        line = self.number(at) - 1
        return self.bytes[line] + len(self.source[self.starts[line] : at].encode())


def comments_above(source: str, at: int) -> list[str]:
    """The lines of the comment block directly above a place, in order; none if another line is between.

    Lines are looked at from below, so what comes before the block isn't.
    """
    found: list[str] = []
    end = source.rfind("\n", 0, at)
    while end >= 0:
        begin = source.rfind("\n", 0, end) + 1
        row = source[begin:end]
        if not re.match(r"\s*(//|\*|/\*|#(?!\[))", row):
            break
        found.append(row.strip())
        end = begin - 1
    return found[::-1]


def _doc_above(source: str, at: int) -> str | None:
    found = comments_above(source, at)[::-1]
    text = [re.sub(r"^(///?!?|/\*\*?|\*/?|#)\s?|\*/$", "", x).strip() for x in reversed(found)]
    return next((x for x in text if x), None)


_NONE = dict.fromkeys(_COLUMNS)


def _row(path: str, language: str, fact: str, **values) -> tuple:
    return tuple((_NONE | {"path": path, "language": language, "fact": fact} | values).values())


def structural_symbols(source: str, language: str) -> list[dict]:
    """Symbols in order of place, with containers for members."""
    masked, lines = blank(source, language), _Lines(source)
    found: list[dict] = []

    def add(name, kind, container, at, end):
        body = source[at:end]
        head = re.split(r"\{|=>", blank(body, language), maxsplit=1)[0]
        found.append({"name": name, "kind": kind, "container": container, "start_line": lines.number(at), "end_line": lines.number(max(at, end - 1)), "start_byte": lines.byte(at), "end_byte": lines.byte(end), "signature": body[: len(head)].strip(), "body": body, "doc": _doc_above(source, at), "at": at, "end": end})

    for pattern, kind in _DECLARATIONS.get(language, []):
        for m in pattern.finditer(masked):
            at = m.start() + len(m[1])
            add(m[3], kind or m[2].rstrip("*"), None, at, block_end(masked, at))
    if language == "go":
        for m in _GO_METHOD.finditer(masked):
            add(m[2], "method", m[1], m.start(), block_end(masked, m.start()))
    if language == "rust":
        spans = [(m.start(), block_end(masked, m.start()), m[1]) for m in _IMPL.finditer(masked)]
        for s in found:
            inside = [(a, n) for a, e, n in spans if a < s["at"] < e]
            if inside and s["kind"] == "fn":
                s["container"], s["kind"] = max(inside)[1], "method"
    if language in ("typescript", "javascript"):
        for c in [x for x in found if x["kind"] == "class"]:
            for m in _METHOD.finditer(masked, c["at"], c["end"]):
                at = m.start() + len(m[1])
                depth = masked.count("{", c["at"], at) - masked.count("}", c["at"], at)
                if depth == 1 and (m[2] not in _WORDS or m[2] == "constructor"):
                    add(m[2], "method", c["name"], at, block_end(masked, at))
        found = [s for s in found if s["container"] or not any(o is not s and o["at"] < s["at"] and s["end"] <= o["end"] for o in found)]
    return sorted(found, key=lambda s: (s["at"], s["name"]))


def python_symbols(source: str) -> list[dict] | None:
    """Top-level functions and classes, and methods; None if the source doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    rows = source.split("\n")
    starts = [0]
    for x in rows:
        starts.append(starts[-1] + len(x.encode()) + 1)
    found = []

    def add(node, container):
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        body = "\n".join(rows[first - 1 : node.end_lineno])
        head = rows[node.lineno - 1 : node.body[0].lineno - 1] or [rows[node.lineno - 1].split(": ")[0] + ":"]
        doc = next((x.strip() for x in (ast.get_docstring(node) or "").split("\n") if x.strip()), None)
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if container else "function"
        found.append({"name": node.name, "kind": kind, "container": container, "start_line": first, "end_line": node.end_lineno, "start_byte": starts[first - 1], "end_byte": starts[node.end_lineno] - 1, "signature": "\n".join(head).strip(), "body": body, "doc": doc})

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            add(node, None)
            if isinstance(node, ast.ClassDef):
                for x in node.body:
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        add(x, node.name)
    return found


def indented_symbols(source: str) -> list[dict]:
    """Python symbols by indentation, for sources that don't parse."""
    lines, found = _Lines(source), []
    rows = source.split("\n")
    for k, text in enumerate(rows):
        m = re.match(rf"([ \t]*)(?:async\s+)?(def|class)\s+({_IDENT})", text)
        if not m:
            continue
        end = next((j for j in range(k + 1, len(rows)) if rows[j].strip() and len(rows[j]) - len(rows[j].lstrip()) <= len(m[1])), len(rows))
        while end > k + 1 and not rows[end - 1].strip():
            end -= 1
        owner = next((s["name"] for s in reversed(found) if s["kind"] == "class" and s["start_line"] <= k + 1 <= s["end_line"]), None) if m[1] else None
        body = "\n".join(rows[k:end])
        found.append({"name": m[3], "kind": "class" if m[2] == "class" else "method" if owner else "function", "container": owner, "start_line": k + 1, "end_line": end, "start_byte": lines.byte(lines.starts[k]), "end_byte": lines.byte(lines.starts[k]) + len(body.encode()), "signature": text.strip(), "body": body, "doc": None})
    return found


def imports(source: str, language: str) -> Iterator[tuple[str, str | None, str, int]]:
    """(local name, imported name, specifier, level) in order; imported None is the whole module."""
    if language == "python":
        for m in re.finditer(r"^[ \t]*from\s+(\.*)([\w.]*)\s+import\s+(\([^)]*\)|[^\n#]+)|^[ \t]*import\s+([^\n#]+)", source, re.M):
            if m[4]:
                for part in m[4].split(","):
                    name, _, alias = part.strip().partition(" as ")
                    if name:
                        yield alias.strip() or name.split(".")[0], None, name.strip(), 0
            else:
                for part in m[3].strip("()").replace("\n", " ").split(","):
                    name, _, alias = part.strip().partition(" as ")
                    if name:
                        yield alias.strip() or name.strip(), name.strip(), m[2], len(m[1])
    elif language in ("typescript", "javascript"):
        for m in re.finditer(rf"import\s+(?:type\s+)?([^'\";]*?)\s*from\s*['\"]([^'\"]+)['\"]|(?:const|let|var)\s+(\{{[^}}]*\}}|{_IDENT})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", source):
            clause, specifier = (m[1], m[2]) if m[2] else (m[3], m[4])
            for part in re.findall(rf"\*\s+as\s+({_IDENT})", clause):
                yield part, None, specifier, 0
            for part in re.findall(r"\{([^}]*)\}", clause):
                for one in part.split(","):
                    name, _, alias = re.sub(r"^\s*type\s+", "", one).strip().replace(":", " as ").partition(" as ")
                    if name.strip():
                        yield alias.strip() or name.strip(), name.strip(), specifier, 0
            m2 = re.match(rf"\s*({_IDENT})", clause)
            if m2:
                yield m2[1], "default" if m[2] else None, specifier, 0
    elif language == "go":
        for m in re.finditer(r'^import\s+(?:(\w+|\.|_)\s+)?"([^"]+)"|^import\s*\(([^)]*)\)', source, re.M):
            for alias, specifier in [(m[1], m[2])] if m[2] else re.findall(r'(?:(\w+|\.|_)\s+)?"([^"]+)"', m[3]):
                yield alias or specifier.rsplit("/", 1)[-1], None, specifier, 0
    elif language == "rust":
        for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;{]+?)(?:::\{([^}]*)\})?\s*;", source, re.M):
            for one in m[2].split(",") if m[2] else [m[1].rsplit("::", 1)[-1]]:
                name, _, alias = one.strip().partition(" as ")
                base = m[1] if m[2] else m[1].rsplit("::", 1)[0]
                if name:
                    yield alias.strip() or name.strip(), name.strip(), base.strip(), 0


def reexports(source: str) -> Iterator[tuple[str | None, str | None, str]]:
    """(exported name, original name, specifier); a wildcard has neither name."""
    for m in re.finditer(r"export\s+(?:type\s+)?(?:\{([^}]*)\}|\*(?:\s+as\s+(\w+))?)\s*from\s*['\"]([^'\"]+)['\"]", source):
        if m[1] is None:
            yield m[2], None, m[3]
            continue
        for one in m[1].split(","):
            name, _, alias = one.strip().partition(" as ")
            if name:
                yield alias.strip() or name.strip(), name.strip(), m[3]


def generics(signature: str, language: str) -> set[str]:
    """Names that a declaration's own type parameters give."""
    if language == "python":
        inner = re.search(r"^(?:async\s+)?(?:def|class)\s+\w+\s*\[([^\]]*)\]", signature, re.M)
        named = re.findall(r"Generic\[([^\]]*)\]|Protocol\[([^\]]*)\]", signature)
        return {x.split(":")[0].strip(" *") for part in [inner[1] if inner else "", *(a or b for a, b in named)] for x in part.split(",")} - {""}
    opened = "[" if language == "go" else "<"
    m = re.search(r"(?:\w+|impl)\s*" + re.escape(opened) + r"([^()]*?)" + re.escape({"[": "]", "<": ">"}[opened]) + r"\s*(?:[({=]|extends|implements|struct|interface|for|\w)", signature)
    if not m:
        return set()
    return {re.match(r"\s*(?:const\s+|in\s+|out\s+)*'?(\w*)", x)[1] for x in m[1].split(",")} - {""}


_FIELD = re.compile(rf"(?:^|[;{{}}\n])[ \t]*(?:(?:public|private|protected|readonly|static|declare|override)\s+)*({_IDENT})\s*[?!]?\s*:\s*({_IDENT})", re.M)
_INJECTED = re.compile(rf"(?:public|private|protected|readonly)\s+(?:readonly\s+)?({_IDENT})\s*\??\s*:\s*({_IDENT})")


def fields(body: str, language: str) -> dict[str, str]:
    """The declared types of a class's fields, those that its constructor takes included."""
    if language not in ("typescript", "javascript"):
        return {}
    masked = blank(body, language)
    out: dict[str, str] = {}
    inner = masked.partition("{")[2]
    depth, flat = 0, []
    for c in inner:
        depth += c == "{"
        if depth == 0:
            flat.append(c)
        depth -= c == "}" and depth > 0
    for m in _FIELD.finditer("\n" + re.sub(r"\([^)]*\)", "()", "".join(flat))):
        out.setdefault(m[1], m[2])
    made = re.search(r"constructor\s*\(([^)]*)\)", masked)
    for m in _INJECTED.finditer(made[1] if made else ""):
        out.setdefault(m[1], m[2])
    return out


#: What facts there are; all but the last two are of symbols.
FACTS = ("symbol", "ref", "call", "field", "import", "reexport")


def facts_of(path: str, language: str, source: str, kinds: Collection[str] = FACTS) -> list[tuple]:
    """All facts of these kinds about one file."""
    symbols = []
    if not {"symbol", "ref", "call", "field"}.isdisjoint(kinds):
        symbols = (python_symbols(source) or indented_symbols(source)) if language == "python" else structural_symbols(source, language)
    builtin = BUILTINS.get(language, frozenset())
    out = []
    for k, s in enumerate(symbols):
        if "symbol" in kinds:
            out.append(_row(path, language, "symbol", ord=k, symbol_ord=k, **{c: v for c, v in s.items() if c in _NONE}))
        if "ref" in kinds or "call" in kinds:
            masked = re.sub(r"#[^\n]*", "", s["body"]) if language == "python" else blank(s["body"], language)
        if "ref" in kinds:
            own = generics(s["signature"], language)
            seen: dict[str, None] = {}
            for m in _TYPE.finditer(masked):
                if m[1] != s["name"] and m[1] not in builtin and m[1] not in own:
                    seen.setdefault(m[1])
            out += [_row(path, language, "ref", ord=j, symbol_ord=k, name=name) for j, name in enumerate(seen)]
        if "call" in kinds:
            calls: dict[tuple, None] = {}
            for m in _CALL.finditer(masked):
                if m[2] not in _WORDS and m[2] != s["name"] and (m[1] or "") not in _WORDS:
                    calls.setdefault((m[1], m[2]))
            out += [_row(path, language, "call", ord=j, symbol_ord=k, receiver=r, name=c) for j, (r, c) in enumerate(calls)]
        if "field" in kinds and s["kind"] == "class":
            out += [_row(path, language, "field", ord=j, symbol_ord=k, container=s["name"], name=n, imported=t) for j, (n, t) in enumerate(fields(s["body"], language).items())]
    if "import" in kinds:
        out += [_row(path, language, "import", ord=k, name=a, imported=b, specifier=c, level=d) for k, (a, b, c, d) in enumerate(imports(source, language))]
    if "reexport" in kinds and language in ("typescript", "javascript"):
        out += [_row(path, language, "reexport", ord=k, name=a, imported=b, specifier=c) for k, (a, b, c) in enumerate(reexports(source))]
    return out


#: Facts, and characters of their files, after which a batch is handed on.
BATCH_ROWS, BATCH_CHARS = 20_000, 8_000_000


def extract(files: DataFrame, kinds: Collection[str] = FACTS) -> DataFrame:
    """The facts of these kinds of all files (path, language, content); files of other languages or without content have none.

    Files stay in their partitions, each of which one task scans: ``spread`` many files first where few row groups hold them.
    """
    kinds = tuple(kinds)

    def scan(batches):
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
        packed = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        rows, chars = [], 0
        for b in batches:
            for path, language, text in zip(*[c.to_pylist() for c in b.columns]):
                if text and language:
                    rows += facts_of(path, language, text, kinds)
                    chars += len(text)
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS and rows:
                        yield packed(rows)
                        rows, chars = [], 0
        if rows:
            yield packed(rows)

    return files.select("path", "language", "content").mapInArrow(scan, SCHEMA)
