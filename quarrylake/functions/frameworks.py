"""What web frameworks tie to a symbol beyond its own text: schemas, dependencies, serializers, hooks, guards.

An analyzer looks at one file and gives references: (symbol, container, role, name, detail). Roles that
name types are in ``TYPE_ROLES``; the others name what is called or what stands before the symbol. Links
between classes (a serializer's model, a model's relations) have the role ``link`` and the class as symbol.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions.extract import blank, block_end, structural_symbols

Ref = tuple[str | None, str | None, str, str, str | None]

TYPE_ROLES = ("response", "parameter", "serializer", "model", "permission", "pagination", "filter", "props", "dto")
PYTHON_BUILTINS = frozenset(
    "str int float bool bytes dict list set tuple type object None Any Optional Union List Dict Set Tuple Annotated Literal Callable Iterable Iterator Sequence Mapping Generic TypeVar ClassVar Final Type "
    "Depends Security Query Path Body Header Cookie File Form Request Response JSONResponse BackgroundTasks WebSocket UploadFile HTTPException status datetime date time timedelta Decimal UUID uuid".split()
)
TS_BUILTINS = frozenset(
    "string number boolean void any unknown never null undefined object symbol bigint Promise Array Record Partial Required Readonly Pick Omit Map Set Date Error Function Observable Request Response NextFunction "
    "React JSX ReactNode ReactElement HTMLElement Express".split()
)
JAVA_BUILTINS = frozenset("String Integer Long Double Float Boolean Short Byte Character Object Void void int long double float boolean short byte char List Map Set Optional Collection Mono Flux Page Valid".split())
_IDENT = r"[A-Za-z_$][\w$]*"
_VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "trace")


def _names(node: ast.AST | None) -> list[str]:
    """Identifiers of an annotation or expression, in order, also those in a string annotation; no builtins."""
    out: list[str] = []

    def visit(x: ast.AST) -> None:
        if isinstance(x, ast.Name):
            out.append(x.id)
        elif isinstance(x, ast.Constant) and isinstance(x.value, str):
            out.extend(re.findall(r"\b[A-Z]\w*", x.value))
        elif isinstance(x, ast.Attribute):
            out.append(x.attr)
        elif isinstance(x, ast.Call):
            visit(x.func)
        else:
            for child in ast.iter_child_nodes(x):
                visit(child)

    if node is not None:
        visit(node)
    return [x for x in dict.fromkeys(out) if x not in PYTHON_BUILTINS]


def _depends(node: ast.AST | None) -> list[str]:
    """What Depends() and Security() are given within an expression."""
    calls = [x for x in ast.walk(node) if isinstance(x, ast.Call)] if node is not None else []
    named = [c for c in calls if (c.func.id if isinstance(c.func, ast.Name) else getattr(c.func, "attr", "")) in ("Depends", "Security")]
    return list(dict.fromkeys(n for c in named if c.args for n in _names(c.args[0])))


def _tree(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError):
        return None


def _defs(tree: ast.Module) -> Iterator[tuple[ast.AST, str | None]]:
    for node in tree.body:
        yield node, None
        if isinstance(node, ast.ClassDef):
            for x in node.body:
                yield x, node.name


def fastapi(path: str, source: str) -> Iterator[Ref]:
    """Routes (method and path), response models, parameter schemas and dependencies of functions."""
    tree = _tree(source)
    for node, owner in _defs(tree) if tree else ():
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        route, response, parameter, dependency = [], [], [], []
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr.lower() in (*_VERBS, "api_route", "websocket"):
                where = next((a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
                route.append((d.func.attr.lower(), where))
                for k in d.keywords:
                    if k.arg == "response_model":
                        response += _names(k.value)
                    elif k.arg == "dependencies":
                        dependency += _depends(k.value)
        a = node.args
        for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs):
            if arg.annotation is not None:
                dependency += _depends(arg.annotation)
                parameter += [n for n in _names(arg.annotation) if n not in _depends(arg.annotation)]
        for default in (*a.defaults, *(x for x in a.kw_defaults if x is not None)):
            dependency += _depends(default)
        if not route and not dependency:
            continue
        response += _names(node.returns)
        for verb, where in route:
            yield node.name, owner, "route", verb, where
        for role, names in (("response", response), ("parameter", parameter), ("dependency", dependency)):
            for n in dict.fromkeys(names):
                yield node.name, owner, role, n, None
    for node, _ in _defs(tree) if tree else ():
        if isinstance(node, ast.ClassDef) and any(b in ("BaseModel", "SQLModel") for base in node.bases for b in _names(base) or [getattr(base, "id", "")]):
            for x in node.body:
                if isinstance(x, ast.AnnAssign):
                    for n in _names(x.annotation):
                        yield node.name, None, "link", n, "parameter"


def django(path: str, source: str) -> Iterator[Ref]:
    """Serializers, models, permissions, pagination and filters of views; models of serializers; relations of models."""
    tree = _tree(source)
    for node, _ in _defs(tree) if tree else ():
        if not isinstance(node, ast.ClassDef):
            continue
        bases = [n for b in node.bases for n in ([b.id] if isinstance(b, ast.Name) else [b.attr] if isinstance(b, ast.Attribute) else [])]
        found: list[tuple[str, str]] = []
        for x in node.body:
            if isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name):
                name, value = x.targets[0].id, x.value
                last = value.attr if isinstance(value, ast.Attribute) else getattr(value, "id", None)
                if name == "serializer_class" and last:
                    found.append(("serializer", last))
                elif name == "queryset":
                    chain = re.match(r"([\w.]+?)\.objects\b", ast.unparse(value))
                    if chain:
                        found.append(("model", chain[1].rsplit(".", 1)[-1]))
                elif name == "permission_classes":
                    found += [("permission", n) for n in _names(value)]
                elif name == "pagination_class" and last:
                    found.append(("pagination", last))
                elif name == "filter_backends":
                    found += [("filter", n) for n in _names(value)]
                elif isinstance(value, ast.Call):
                    callee = value.func.attr if isinstance(value.func, ast.Attribute) else getattr(value.func, "id", "")
                    if callee.endswith("Serializer"):
                        yield node.name, None, "link", callee, "serializer"
                    elif callee in ("ForeignKey", "OneToOneField", "ManyToManyField") and value.args:
                        to = value.args[0]
                        to = to.value.rsplit(".", 1)[-1] if isinstance(to, ast.Constant) and isinstance(to.value, str) else (_names(to) or [None])[0]
                        if to and to != "self":
                            yield node.name, None, "link", to, "model"
            elif isinstance(x, ast.ClassDef) and x.name == "Meta":
                for y in x.body:
                    if isinstance(y, ast.Assign) and getattr(y.targets[0], "id", "") == "model":
                        for n in _names(y.value):
                            yield node.name, None, "link", n, "model"
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for d in x.decorator_list:
                    for k in d.keywords if isinstance(d, ast.Call) else ():
                        if k.arg == "serializer_class":
                            found += [("serializer", n) for n in _names(k.value)]
                        elif k.arg == "permission_classes":
                            found += [("permission", n) for n in _names(k.value)]
                if x.name == "get_serializer_class":
                    found += [("serializer", n) for r in ast.walk(x) if isinstance(r, ast.Return) for n in _names(r.value) if n.endswith("Serializer")]
        if any("View" in b for b in bases) or any(role in ("serializer", "model", "permission") for role, _ in found):
            members = [x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            for role, n in dict.fromkeys(found):
                yield node.name, None, role, n, None
                for m in members:
                    yield m, node.name, role, n, None


def _symbols(source: str) -> list[dict]:
    return structural_symbols(source, "typescript")


def _split(text: str) -> list[str]:
    """Parts between commas that aren't in brackets or strings."""
    out, depth, at, masked = [], 0, 0, blank(text, "typescript")
    for k, c in enumerate(masked):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[at:k].strip())
            at = k + 1
    return [x for x in [*out, text[at:].strip()] if x]


def _closing(masked: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for k in range(at, len(masked)):
        depth += (masked[k] in "([{") - (masked[k] in ")]}")
        if depth == 0:
            return k
    return len(masked)


def react(path: str, source: str) -> Iterator[Ref]:
    """Types of a component's props and the hooks that aren't the library's own."""
    hook = re.compile(rf"(?:\.|\b)(use[A-Z][\w$]*)\s*(?:<[^>(]*>)?\(")
    own = {f"use{x}" for x in "State Effect Context Reducer Callback Memo Ref ImperativeHandle LayoutEffect Id Transition DeferredValue SyncExternalStore ActionState Optimistic".split()}
    for s in _symbols(source):
        body = s["body"]
        head = re.match(r"[^{=]*?\b(?:function\*?|const|let|var)\s+[\w$]+\s*(?:<[^>]*>)?\s*(:[^=]*?)?(?:=\s*(?:async\s*)?)?(\(|(?:[\w.]+)\s*<)?", body)
        props = None
        masked = blank(body, "typescript")
        opened = masked.find("(")
        wrapped = re.search(r"=\s*(?:React\.)?(?:forwardRef|memo)\s*<([^>]*)>", body)
        annotated = re.search(r"(?:const|let|var)\s+[\w$]+\s*:\s*(?:React\.)?(?:FC|FunctionComponent|VFC|ComponentType)\s*<\s*([\w$]+)", body)
        if annotated:
            props = annotated[1]
        elif wrapped:
            parts = _split(wrapped[1])
            props = parts[-1] if parts else None
        elif head and opened >= 0:
            first = (_split(body[opened + 1 : _closing(masked, opened)]) or [""])[0]
            typed = re.search(r":\s*([A-Za-z_$][\w$.]*)[^:]*$", first)
            props = typed[1] if typed else None
        if props and props not in TS_BUILTINS:
            yield s["name"], s["container"], "props", props, None
        for h in dict.fromkeys(m[1] for m in hook.finditer(masked)):
            if h not in own and h != s["name"]:
                yield s["name"], s["container"], "hook", h, None


def express(path: str, source: str) -> Iterator[Ref]:
    """Routes with what stands before their handler, and the types that middleware and requests name."""
    masked = blank(source, "typescript")
    heads = {s["name"]: s["body"].partition("(")[2] for s in _symbols(source)}
    taken = {n: h[: _closing("(" + blank(h, "typescript"), 0)] for n, h in heads.items()}
    for m in re.finditer(rf"({_IDENT})\.(get|post|put|patch|delete|use|all)\s*\(", masked):
        inner = source[m.end() : _closing(masked, m.end() - 1)]
        args = _split(inner)
        where = args[0].strip("\"'`") if args and args[0][:1] in "\"'`" else None
        rest = args[1:] if where is not None else args
        if not rest or (where is None and m[2] != "use"):
            continue
        handler = rest[-1]
        inline = re.match(r"(?:async\s+)?function\s+([\w$]+)", handler)
        name = inline[1] if inline else (re.search(rf"({_IDENT})\s*$", handler) or [None, None])[1] if re.fullmatch(r"[\w$.]+", handler) else None
        name = name or f"{m[2]} {where or ''}".strip()
        yield name, None, "route", m[2], where
        dtos = re.findall(r"\b\w+\b", " ".join(re.findall(r"Request\s*<([^()]*)>", handler + " " + taken.get(name, ""))))
        for step in rest[:-1]:
            if re.fullmatch(r"[\w$.]+", step) or re.match(r"[\w$.]+\s*\(", step):
                yield name, None, "middleware", step, None
                dtos += [x for x in re.findall(r"\b[A-Za-z_$][\w$]*", step.partition("(")[2]) if re.search(r"(DTO|Dto|Schema|Request)$", x)]
        for d in dict.fromkeys(dtos):
            if d not in TS_BUILTINS and d[:1].isupper():
                yield name, None, "dto", d, None


_NEST = r"@(?:UseGuards|UseInterceptors|UsePipes|UseFilters)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)"


def nest(path: str, source: str) -> Iterator[Ref]:
    """Guards, interceptors, pipes and filters of classes and methods; types of parameters and results."""
    symbols = _symbols(source)
    guards = lambda text: [x for inner in re.findall(_NEST, text) for x in re.findall(rf"\b{_IDENT}", inner)]
    for c in (s for s in symbols if s["kind"] == "class"):
        before = _decorators(source, c["at"])
        for s in (x for x in symbols if x["container"] == c["name"]):
            own = _decorators(source, s["at"])
            for g in dict.fromkeys(guards(before) + guards(own)):
                yield s["name"], c["name"], "guard", g, None
            masked = blank(s["body"], "typescript")
            opened = masked.find("(")
            closed = _closing(masked, opened) if opened >= 0 else 0
            types = [m[1] for p in _split(s["body"][opened + 1 : closed]) if (m := re.search(r":\s*([A-Za-z_$][\w$]*)[^:]*$", p))]
            result = re.match(r"\s*:\s*([^{]+)", s["body"][closed + 1 :])
            if result:
                types += [(re.findall(r"[A-Za-z_$][\w$]*", result[1].partition("<")[2]) or re.findall(r"[A-Za-z_$][\w$]*", result[1]))[0]]
            for t in dict.fromkeys(types):
                if t not in TS_BUILTINS:
                    yield s["name"], c["name"], "dto", t, None


def _decorators(source: str, at: int) -> str:
    """The run of decorators that ends where a symbol begins."""
    rows, found = source[:at].split("\n"), []
    rows = rows[:-1] if not rows[-1].strip() else rows
    while rows:
        row = rows.pop()
        text = row.strip()
        if not text or re.match(r"(@|export\b|default\b|[)\]}]|\w[\w\s]*:)", text) or found and found[-1].count(")") > found[-1].count("("):
            if text and not text.startswith("@") and not re.match(r"(export|default)\b", text) and not (found and text.endswith(("(", ","))) and not text.startswith(")"):
                break
            found.append(text)
            continue
        break
    return "\n".join(reversed(found))


_JAVA_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+([\w<>\[\], ?.]+?)\s+(\w+)\s*\(", re.M)


def spring(path: str, source: str) -> Iterator[Ref]:
    """Security annotations, bodies of requests and the results' inner type of a controller's methods."""
    masked = blank(source, "typescript")
    class_at = re.search(r"\bclass\s+(\w+)", masked)
    owner = class_at[1] if class_at else None
    secured = lambda text: re.findall(r"@(?:PreAuthorize|Secured|RolesAllowed)\b[^\n]*", text)
    of_class = secured(source[: class_at.start()]) if class_at else []
    for m in _JAVA_METHOD.finditer(masked):
        opened = m.end() - 1
        head = source[opened + 1 : _closing(masked, opened)]
        rows, above = source[: m.start()].rstrip().split("\n"), []
        while rows and rows[-1].strip().startswith("@"):
            above.append(rows.pop().strip())
        for s in dict.fromkeys(of_class + secured("\n".join(reversed(above)))):
            yield m[2], owner, "security", s, None
        types = re.findall(r"@RequestBody\s+(?:@\w+(?:\([^)]*\))?\s+|final\s+)*(\w+)", head)
        inner = re.search(r"<\s*(?:\w+\s*<\s*)*(\w+)", source[m.start(1) : m.end(1)])
        for t in dict.fromkeys(types + ([inner[1]] if inner else [])):
            if t not in JAVA_BUILTINS:
                yield m[2], owner, "dto", t, None


def local_type(source: str, name: str) -> str | None:
    """The text of a class, record, interface, enum or type alias that a file declares (braced languages)."""
    masked = blank(source, "typescript")
    m = re.search(rf"^[ \t]*(?:export\s+)?(?:(?:public|private|protected|static|final|abstract|data)\s+)*(?:class|record|interface|enum|type)\s+{re.escape(name)}\b", masked, re.M)
    if not m:
        return None
    at = m.start() + len(m[0]) - len(m[0].lstrip())
    return source[at : block_end(masked, at)].strip()


def minified_class(body: str) -> str:
    """A Python class without bodies: header, first line of its docstring, fields, Meta and Config, stubs of methods."""
    tree = _tree(body)
    node = next((x for x in tree.body if isinstance(x, ast.ClassDef)), None) if tree else None
    if node is None:
        return body
    rows = body.split("\n")
    out = ["\n".join(rows[min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1 : node.body[0].lineno - 1]).rstrip() or rows[0]]
    doc = ast.get_docstring(node)
    pad = " " * node.body[0].col_offset
    if doc:
        out.append(f'{pad}"""{doc.strip().splitlines()[0]}"""')
    for x in node.body:
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            head = ast.unparse(ast.copy_location(type(x)(name=x.name, args=x.args, body=[ast.Expr(ast.Constant(...))], decorator_list=[], returns=x.returns, type_params=[]), x))
            out.append(pad + " ".join(head.split()))
        elif not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant)) and not isinstance(x, ast.Pass):
            out += rows[x.lineno - 1 : x.end_lineno]
    if len(out) == 1:
        out.append(f"{pad}...")
    return "\n".join(out)


def collapsed_jsx(body: str, depth: int = 2, least: int = 3) -> str:
    """A component's text with plain markup folded: elements ``depth`` or more deep, of ``least`` or more lines,
    in which no component of one's own occurs. Markup begins where a return gives it."""
    edits = []
    for m in re.finditer(r"\breturn\s*\(?\s*(?=<)", body):
        node = _element(body, m.end())
        if node:
            _fold(body, node, 0, depth, least, edits)
    for begin, end, text in sorted(edits, reverse=True):
        body = body[:begin] + text + body[end:]
    return body


def _element(text: str, at: int) -> dict | None:
    """The markup element at ``at``: tag, place, where its opening ends and its closing begins, children."""
    m = re.compile(r"<\s*([\w.:-]*)").match(text, at)
    if not m:
        return None
    k, depth, quote = m.end(), 0, ""
    while k < len(text) and (depth or quote or text[k] != ">"):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        else:
            depth += (c == "{") - (c == "}")
        k += 1
    node = {"tag": m[1], "begin": at, "opened": k + 1, "closing": k + 1, "end": k + 1, "children": []}
    if text[k - 1 : k] == "/":
        return node
    k += 1
    while k < len(text):
        if text.startswith("</", k):
            node["closing"], close = k, text.find(">", k)
            node["end"] = close + 1 if close >= 0 else len(text)
            return node
        if re.compile(r"<[\w>]").match(text, k):
            child = _element(text, k)
            if child is None:
                return None
            node["children"].append(child)
            k = child["end"]
        else:
            k += 1
    return None


def _own_inside(node: dict) -> bool:
    return any(c["tag"][:1].isupper() or _own_inside(c) for c in node["children"])


def _fold(text: str, node: dict, level: int, depth: int, least: int, edits: list) -> None:
    lines = text.count("\n", node["begin"], node["end"]) + 1
    if node["tag"] == "svg" and not node["children"] and node["closing"] == node["end"]:
        edits.append((node["begin"], node["end"], "<svg />"))
    elif level >= depth and lines >= least and node["tag"] and not node["tag"][0].isupper() and not _own_inside(node):
        edits.append((node["opened"], node["closing"], f"{{/* {lines} lines of markup */}}"))
    else:
        for c in node["children"]:
            _fold(text, c, level + 1, depth, least, edits)


@dataclass(frozen=True)
class Analyzer:
    """One framework: the files it looks at and how it reads them."""

    name: str
    extensions: tuple[str, ...]
    marks: tuple[str, ...]
    refs: Callable[[str, str], Iterator[Ref]]
    #: Extensions and parts of paths that suffice without a mark.
    always: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()

    def matches(self, path: str, source: str) -> bool:
        extension = path.rsplit(".", 1)[-1].lower()
        if extension in self.always:
            return True
        return extension in self.extensions and (any(m in source for m in self.marks) or any(f in path for f in self.folders))

    def matching(self, path: Column, source: Column) -> Column:
        """``matches`` as a column expression."""
        extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
        marked = F.lit(False)
        for m in self.marks:
            marked = marked | F.contains(source, F.lit(m))
        for f in self.folders:
            marked = marked | F.contains(path, F.lit(f))
        return extension.isin(*self.always) | (extension.isin(*self.extensions) & marked) if self.always else extension.isin(*self.extensions) & marked


_SCRIPT = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
DEFAULTS = (
    Analyzer("fastapi", ("py", "pyi"), ("fastapi", "FastAPI", "APIRouter", "Depends", "BaseModel", "response_model=", "@router.", "@app."), fastapi),
    Analyzer("django", ("py", "pyi"), ("rest_framework", "django.db", "serializers", "viewsets", "models.Model", "APIView", "permission_classes", "serializer_class", "BasePermission"), django),
    Analyzer("react", ("ts", "js"), ("'use client'", '"use client"', "'use server'", '"use server"', "from 'react'", 'from "react"', "from 'next/", 'from "next/'), react, ("tsx", "jsx"), ("app/", "pages/", "components/")),
    Analyzer("express", _SCRIPT, ("express", "Router", ".get(", ".post(", ".put(", ".delete(", ".use("), express),
    Analyzer("nest", ("ts", "js"), ("@nestjs", "@Controller", "@Injectable", "@UseGuards", "@UseInterceptors", "@UsePipes", "@UseFilters", "@Body(", "@Param(", "@Query("), nest),
    Analyzer("spring", ("java", "kt", "scala", "groovy"), ("org.springframework", "@RestController", "@Controller", "@Service", "@Repository", "Mapping", "@RequestBody", "@PreAuthorize", "@Secured"), spring),
)


@dataclass
class Registry:
    """Analyzers in the order in which they apply."""

    analyzers: list[Analyzer] = field(default_factory=lambda: list(DEFAULTS))

    @staticmethod
    def empty() -> Registry:
        return Registry([])

    def register(self, analyzer: Analyzer) -> None:
        self.analyzers.append(analyzer)

    def matching(self, path: str, source: str) -> list[Analyzer]:
        return [a for a in self.analyzers if a.matches(path, source)]

    def refs(self, path: str, source: str) -> list[tuple]:
        """(analyzer, its number, ord, symbol, container, role, name, detail) of all matching analyzers; equal ones once."""
        out: dict[tuple, tuple] = {}
        for k, a in enumerate(self.analyzers):
            if a.matches(path, source):
                for r in a.refs(path, source):
                    out.setdefault(r[:4], (a.name, k, len(out), *r))
        return list(out.values())
