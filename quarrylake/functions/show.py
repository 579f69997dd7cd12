"""How things are shown and how what users type is read: Column expressions, as in ``text``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCES = {"ts": "typescript", "typescript": "typescript", "tsx": "tsx", "js": "javascript", "javascript": "javascript", "jsx": "jsx", "py": "python", "python": "python", "golang": "go", "go": "go", "rs": "rust", "rust": "rust"}


def fence_tag(language: Column) -> Column:
    """The tag of a code fence: aliases in any case have one spelling, others stay as they are; text for null."""
    known = F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv])
    return F.coalesce(known[F.lower(language)], language, F.lit("text"))


def is_ts_family(language: Column) -> Column:
    return F.coalesce(F.lower(language).isin("typescript", "javascript"), F.lit(False))


def currency(x: Column) -> Column:
    return F.format_string("$%.2f", x.cast("double"))


def percentage(x: Column) -> Column:
    return F.format_string("%.1f%%", x.cast("double"))


def short_name(name: Column, most: int = 14) -> Column:
    return F.substring(name, 1, most)


def tail_name(name: Column, most: int = 32, kept: int = 29) -> Column:
    """The end of a long name after dots; a short one whole."""
    return F.when(F.length(name) > most, F.concat(F.lit("..."), F.right(name, F.lit(kept)))).otherwise(name)


def rfc3339(ts: Column, milliseconds: bool = False) -> Column:
    """A time as text in UTC (the session's zone must be that); times before 1970 are shown as its beginning."""
    ts = F.greatest(ts.cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if milliseconds else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_rfc3339(milliseconds: bool = False) -> Column:
    return rfc3339(F.current_timestamp(), milliseconds)


def short_time(stamp: Column) -> Column:
    """The first 16 characters of an RFC 3339 time with a space for the T; a shorter text as it is."""
    return F.when(F.length(stamp) >= 16, F.translate(F.substring(stamp, 1, 16), "T", " ")).otherwise(stamp)


def target_path(target: Column) -> Column:
    """What comes before the colon of ``path:symbol``; a drive letter's colon isn't it. Null without one."""
    return F.nullif(F.regexp_extract(target, r"^((?:[A-Za-z]:)?[^:]*):", 1), F.lit(""))


def target_symbol(target: Column) -> Column:
    return F.when(target.rlike(r"^(?:[A-Za-z]:)?[^:]*:"), F.regexp_extract(target, r"(?s)^(?:[A-Za-z]:)?[^:]*:(.*)$", 1))


def symbol_list(text: Column) -> Column:
    """Names between commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def unquoted(text: Column) -> Column:
    """A Python string literal's text: without prefix letters and triple or single quotes; other text as it is."""
    bare = F.regexp_extract(F.trim(text), r"(?s)^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*)\1$", 2)
    return F.when(F.trim(text).rlike(r"(?s)^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*)\1$"), bare).otherwise(F.trim(text))


def generic_arguments(text: Column) -> Column:
    """The arguments between the outermost angle brackets, split at commas, trimmed; none without brackets."""
    inner = F.regexp_extract(text, r"(?s)<(.*)>", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(x)))


def last_identifier(text: Column) -> Column:
    """The identifier that ends an argument list: what a route's handler is called."""
    return F.nullif(F.regexp_extract(text, r"([A-Za-z_$][\w$]*)\W*$", 1), F.lit(""))


def inner_identifier(text: Column, method: str) -> Column:
    """The identifier inside ``method( )``, as in ``post(checkout)``."""
    return F.nullif(F.regexp_extract(text, rf"\b{method}\(\s*([A-Za-z_][\w:]*)", 1), F.lit(""))


def is_pascal_case(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\p{Lu}"), F.lit(False))


def tag_name(tag: Column) -> Column:
    """The name of a markup tag's text."""
    return F.regexp_extract(tag, r"^</?\s*([\w.:-]+)", 1)


_OWN_HOOKS = ("State", "Effect", "Context", "Reducer", "Callback", "Memo", "Ref", "ImperativeHandle", "LayoutEffect", "Id", "Transition", "DeferredValue", "SyncExternalStore", "ActionState", "Optimistic")


def is_custom_hook(name: Column) -> Column:
    """``use`` and a capital, and none of the library's own."""
    return F.coalesce(name.rlike(r"^use\p{Lu}") & ~name.isin(*(f"use{x}" for x in _OWN_HOOKS)), F.lit(False))


def receiver_type(receiver: Column) -> Column:
    """The type of a method's receiver or of an implementation: without name, stars and type arguments."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(receiver, r"([\w.*&]+(?:\[.*\]|<.*>)?)\s*\)?$", 1), r"[\[<].*$", ""), r"[*&]", "")


def line_ending(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), "crlf").otherwise("lf")


def first_bytes(text: Column, most: int = 50) -> Column:
    """The first line's beginning, of at most ``most`` characters."""
    return F.trim(F.substring(F.element_at(F.split(text, "\n"), 1), 1, most))


_TEST_MARK = r"^\s*(#\[test\]|def test_|it\(|test\(|func Test)"


def test_snippet(text: Column, marker: str = _TEST_MARK, whole: int = 25, shown: int = 20) -> Column:
    """Of a test file: all of up to 25 lines; else 20 from the first line that begins a test; else the first 20."""
    rows = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    at = F.array_position(F.transform(rows, lambda x: x.rlike(marker)), True)
    return F.array_join(F.when(F.size(rows) <= whole, rows).otherwise(F.slice(rows, F.greatest(at, F.lit(1)).cast("int"), shown)), "\n")


def route_of(line: Column) -> Column:
    """(method, path) of a route that a line of source declares, as struct; null for others."""
    pattern = r"""\.(get|post|put|patch|delete|GET|POST|PUT|PATCH|DELETE)\(\s*["'`](/[^"'`]*)["'`]"""
    return F.when(line.rlike(pattern), F.struct(F.upper(F.regexp_extract(line, pattern, 1)).alias("method"), F.regexp_extract(line, pattern, 2).alias("path")))


def replaced(text: Column, edits: Column) -> Column:
    """``text`` with edits (begin, end, with; offsets of characters) made, the rightmost first, so offsets stay true."""
    ordered = F.array_sort(edits, lambda a, b: F.when(a["begin"] > b["begin"], -1).when(a["begin"] < b["begin"], 1).otherwise(0))
    return F.aggregate(ordered, text, lambda acc, e: F.concat(acc.substr(F.lit(1), e["begin"].cast("int")), e["with"], acc.substr((e["end"] + 1).cast("int"), F.length(acc))))
