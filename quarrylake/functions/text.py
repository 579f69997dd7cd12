"""Scalar text and number functions as Column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, groups of up to three digits, and runs of punctuation: a count of pre-tokens, not of BPE tokens.
TOKEN_RE = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
#: Weights of the sliced-size estimate by language; others count 1.
LANGUAGE_WEIGHTS = {"rust": 1.05, "go": 1.02, "typescript": 1.0, "javascript": 1.0, "python": 0.95}
PRICES = {"economy": 0.5, "standard": 3.0, "frontier": 15.0}


#: A word boundary between ASCII letters, digits and underscores and anything else.
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def in_ascii(pattern: str) -> str:
    r"""A pattern whose ``\s`` and ``\b``, outside of brackets, are those of RE2: Java's ``\b`` knows letters beyond ASCII
    (before version 19) and its ``\s`` the vertical tab."""
    return pattern.replace(r"\s", r"[\t\n\f\r ]").replace(r"\b", _EDGE)


def count_tokens(text: Column) -> Column:
    """Pre-tokens of a text; 0 for null or empty."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0)).cast("long")


def count_lines(text: Column) -> Column:
    """Lines, without counting an empty one after a last newline; 0 for null or empty."""
    pieces = F.size(F.split(text, "\n")) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(pieces, F.lit(1))).cast("long")


def round2(x: Column) -> Column:
    """Two decimals, half away from zero, on the scaled double (not on its decimal expansion)."""
    return F.round(x * 100) / 100


def savings_percentage(raw: Column, sliced: Column) -> Column:
    """Share saved in percent, never negative; 0 without anything to save."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(round2(F.greatest(F.lit(0.0), (1 - sliced.cast("double") / raw) * 100)))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def estimate_sliced(tokens: Column, weight: Column) -> Column:
    """Estimated tokens after slicing: all up to 20, then a power law between 15 and all."""
    law = F.round((F.lit(3.2) * F.pow(tokens.cast("double"), F.lit(0.55)) + 25) * weight)
    return F.when(tokens <= 20, tokens).otherwise(F.greatest(F.lit(15.0), F.least(tokens.cast("double"), law)).cast("long")).cast("long")


def language_weight(language: Column) -> Column:
    out = F.lit(1.0)
    for name, w in LANGUAGE_WEIGHTS.items():
        out = F.when(language == name, F.lit(w)).otherwise(out)
    return out


def cost(saved: Column, price: float) -> Column:
    return round2(saved.cast("double") / 1e6 * price)


def display_language(name: Column) -> Column:
    """A language's display name: known aliases, else its first letter capitalised; Unknown for null."""
    known = {"ts": "TypeScript", "tsx": "TypeScript", "typescript": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "javascript": "JavaScript", "py": "Python", "python": "Python", "rs": "Rust", "rust": "Rust", "go": "Go", "golang": "Go"}
    low = F.lower(name)
    out = F.when(name.isNull() | (name == ""), F.lit("Unknown"))
    for alias, shown in known.items():
        out = out.when(low == alias, F.lit(shown))
    return out.otherwise(F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name))))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def fold_body(text: Column, keep: int = 2, least: int = 6, marker: str = "    // ... body collapsed ...") -> Column:
    """First and last ``keep`` lines with a marker between them, for more than ``least`` lines."""
    rows = lines_of(text)
    short = F.array_join(F.concat(F.slice(rows, 1, keep), F.array(F.lit(marker)), F.slice(rows, -keep, keep)), "\n")
    return F.when(F.size(rows) > least, short).otherwise(text)


def minify_definition(text: Column) -> Column:
    """A definition of up to three lines on one line, else its first and last line and a count of fields."""
    rows = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(rows)
    folded = F.concat(F.element_at(rows, 1), F.lit(" /* "), (n - 2).cast("string"), F.lit(" fields */ "), F.element_at(rows, -1))
    return F.when(n <= 3, F.array_join(rows, " ")).otherwise(folded)


def strip_comment_lines(text: Column) -> Column:
    """Without lines that begin with //, #, * or a block comment's opening."""
    return F.array_join(F.filter(lines_of(text), lambda x: ~F.trim(x).rlike(r"^(//|#|/\*|\*)")), "\n")


def strip_comments(text: Column) -> Column:
    """Without comment lines: //, #, lines that begin a docstring's quotes, and all of a block comment from a line
    that begins one to the line that ends it. One pass over the lines, carrying whether it is in a block."""
    begins = lambda x: F.trim(x)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"))

    def step(acc, x):
        opens = begins(x).startswith("/*")
        closes = F.contains(x, F.lit("*/"))
        dropped = acc["inside"] | opens | begins(x).rlike("^(//|#|\"\"\"|''')")
        inside = F.when(acc["inside"], ~closes).otherwise(opens & ~closes)
        return F.struct(F.when(dropped, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), inside.alias("inside"))

    return F.aggregate(lines_of(text), start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def first_line(text: Column) -> Column:
    return F.trim(F.element_at(lines_of(text), 1))


def normalise_path(path: Column) -> Column:
    """Path without . and with .. folded into its parent."""
    pieces = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    folded = F.aggregate(
        pieces, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def is_binary(head: Column) -> Column:
    """Whether bytes (the first 1024 of a file) hold a NUL or UTF-8 that is wrong before a cut-off tail."""
    tail = r"((C[2-9A-F]|D[0-9A-F])|E[0-9A-F]([89AB][0-9A-F])?|F[0-4]([89AB][0-9A-F]){0,2})$"
    whole = F.unhex(F.regexp_replace(F.hex(head), tail, ""))
    return (F.position(F.lit(b"\x00"), head) > 0) | ~F.is_valid_utf8(whole.cast("string"))


def hunk_range(header: Column) -> tuple[Column, Column]:
    """First new line and number of lines of a unified diff's hunk header (a deletion marks its line)."""
    start = F.regexp_extract(header, r"\+(\d+)", 1).cast("long")
    count = F.regexp_extract(header, r"\+\d+,(\d+)", 1)
    return start, F.greatest(F.coalesce(F.when(count != "", count.cast("long")), F.lit(1)), F.lit(1))
