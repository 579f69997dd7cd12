"""Resolution over facts: import specifiers to files, names to declarations, calls to signatures."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.lookup import ancestors, first_per_key
from quarrylake.operators.settle import settle

_TS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")


def candidate_paths(path: str, language: str | None, specifier: str, level: int, roots: tuple[str, ...] = ("", "src", "lib", "app", "backend"), package_first: bool = False) -> list[str]:
    """Files that a specifier in ``path`` may mean, the likeliest first; of an unknown language, those of all.

    ``package_first``: a Python folder with __init__ comes before the module of the same name.
    """
    if language not in ("typescript", "javascript", "python", "rust", "go"):
        return list(dict.fromkeys(c for x in ("typescript", "python", "rust") for c in candidate_paths(path, x, specifier, level, roots, package_first)))
    here = posixpath.dirname(path)
    join = lambda *p: posixpath.normpath(posixpath.join(*p)).removeprefix("./")
    if language in ("typescript", "javascript"):
        if specifier.startswith(("@/", "~/")):
            bases = [join(r, specifier[2:]) for r in ("src", "")]
        elif specifier.startswith("."):
            bases = [join(here, specifier)]
        else:
            return []
        out = []
        for b in bases:
            stem = b[: -len(".js")] if b.endswith(".js") else b
            out += [b] if b.endswith(_TS) else []
            out += [stem + e for e in _TS] + [f"{stem}/index{e}" for e in _TS]
        return list(dict.fromkeys(out))
    if language == "python":
        inner = specifier.replace(".", "/")
        if level:
            base = here
            for _ in range(level - 1):
                base = posixpath.dirname(base)
            bases = [join(base, inner) if inner else base]
        else:
            up, ancestors = here, []
            while up:
                ancestors.append(up)
                up = posixpath.dirname(up)
            bases = [join(r, inner) for r in (*ancestors, *roots)]
        ends = ("/__init__.py", ".py", ".pyi") if package_first else (".py", "/__init__.py", ".pyi")
        return list(dict.fromkeys(b + e for b in bases for e in ends))
    if language == "rust":
        parts = [p for p in specifier.split("::") if p]
        root = path.split("src/")[0] + "src" if "src/" in path else here
        if parts[:1] == ["crate"]:
            base, parts = root, parts[1:]
        elif parts[:1] == ["super"]:
            base, parts = posixpath.dirname(here), parts[1:]
        else:
            base = here
        inner = "/".join(p for p in parts if p != "self")
        return [f"{join(base, inner)}.rs", f"{join(base, inner)}/mod.rs"] if inner else [f"{base}/lib.rs", f"{base}/main.rs"]
    return []


def resolve_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ord, local, imported, target): every import with the first candidate file that exists.

    Go imports name a package, each file of whose folder is a target: the folder under a go.mod whose
    module the specifier begins with, else one that the specifier ends with.
    """
    named = facts.where("fact in ('import', 'reexport')").select("path", "language", "fact", "ord", "name", "imported", "specifier", F.coalesce("level", F.lit(0)).alias("level"))

    # What a specifier may mean depends on its file's folder alone, so it is tried once for all files of a folder.
    key = ["folder", "of", "specifier", "level"]
    named = named.withColumn("folder", F.regexp_replace("path", "[^/]*$", "")).withColumn("of", F.coalesce("language", F.lit("")))

    def candidates(frames):
        for pdf in frames:
            rows = [(*r, k, c) for r in pdf.itertuples(index=False) for k, c in enumerate(candidate_paths(f"{r.folder}_", r.of, r.specifier, r.level))]
            yield pd.DataFrame(rows, columns=[*key, "try", "target"])

    tried = named.select(*key).distinct().mapInPandas(candidates, "folder string, of string, specifier string, level int, try int, target string")
    hits = tried.join(files.select(F.col("path").alias("target")), "target")
    meant = settle(first_per_key(hits, key, F.col("try")).drop("try"))
    best = first_per_key(named.join(meant, key).select("path", "fact", "ord", "target", F.col("name").alias("local"), "imported"), ["path", "fact", "ord"], F.col("target"))
    folders = files.where("language = 'go'").select(F.col("path").alias("target"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder"))
    wanted = named.where("language = 'go' and fact = 'import'").select("path", "fact", "ord", "specifier", F.col("name").alias("local"), "imported")
    modules = files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_replace("path", "/?go\\.mod$", "").alias("base")).where("module != ''")
    inside = F.expr("ltrim('/', substring(specifier, length(module) + 1))")
    own = wanted.withColumn("module", F.explode(ancestors(F.col("specifier")))).join(modules, "module").withColumn("inside", inside)
    own = own.withColumn("folder", F.concat_ws("/", F.nullif("base", F.lit("")), F.nullif("inside", F.lit("")))).join(folders, "folder").withColumn("tier", F.lit(0))
    last = F.element_at(F.split("specifier", "/"), -1)
    beside = wanted.withColumn("last", last).join(folders.withColumn("last", F.element_at(F.split("folder", "/"), -1)), "last").where(F.endswith("specifier", F.col("folder"))).withColumn("tier", F.lit(1))
    columns = ["path", "fact", "ord", "target", "local", "imported", "tier"]
    go = own.select(*columns).unionByName(beside.select(*columns))
    least = go.groupBy("path", "fact", "ord").agg(F.min("tier").alias("tier"))
    go = go.join(least, ["path", "fact", "ord", "tier"]).select("path", "fact", "ord", "target", "local", "imported").distinct()
    return settle(best.select("path", "fact", "ord", "target", "local", "imported").unionByName(go))


def follow_reexports(imports: DataFrame, symbols: DataFrame, depth: int = 5) -> DataFrame:
    """(path, local, target, name): imports followed through re-exports, with renames, to the declaring file.

    Visited (start, file, name) states are kept, where a start is a file and a name asked of it, so cyclic ``export *`` chains end.
    """
    links = imports.where("fact = 'reexport'").select(F.col("path").alias("via"), F.col("local").alias("exported"), F.col("imported").alias("original"), F.col("target").alias("next"))
    wanted = imports.where("fact = 'import'").select("path", "local", F.col("target").alias("first"), F.coalesce("imported", "local").alias("asked"))
    # A name of a file leads where it leads whoever imports it, so it is followed once for all.
    state = settle(wanted.select("first", "asked", F.col("first").alias("target"), F.col("asked").alias("name"), F.lit(0).alias("hops")).distinct())
    everything = state
    for hop in range(1, depth + 1):
        step = state.join(links, (state["target"] == links["via"]) & (links["exported"].isNull() | (links["exported"] == state["name"])))
        step = step.select("first", "asked", F.col("next").alias("target"), F.coalesce("original", "name").alias("name"), F.lit(hop).alias("hops")).distinct()
        state = settle(step.join(everything, ["first", "asked", "target", "name"], "left_anti"))
        if state.isEmpty():
            break
        everything = everything.unionByName(state)
    declared = symbols.where("container IS NULL").select(F.col("path").alias("target"), "name").distinct()
    found = settle(first_per_key(everything.join(declared, ["target", "name"]), ["first", "asked"], F.struct("hops", "target", "name")))
    return settle(first_per_key(wanted.join(found, ["first", "asked"]).select("path", "local", "target", "name", "hops"), ["path", "local"], F.struct("hops", "target", "name")).drop("hops"))


def declarations(facts: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """Names used in files (path, name) with their declaration: here, else imported, else in a sibling file.

    ``links`` is what ``follow_reexports`` gives. Returns path, name, tier (0, 1, 2) and the declaring target, target_ord, kind, signature and body.
    """
    symbols = facts.where("fact = 'symbol' and container IS NULL").select(F.col("path").alias("target"), F.col("ord").alias("target_ord"), F.col("name").alias("declared"), "kind", "signature", "body", "language")
    here = names.join(symbols, (F.col("path") == F.col("target")) & (F.col("name") == F.col("declared"))).withColumn("tier", F.lit(0))
    linked = links.select("path", F.col("local").alias("name"), F.col("target").alias("to"), F.col("name").alias("as"))
    there = names.join(linked, ["path", "name"]).join(symbols, (F.col("to") == F.col("target")) & (F.col("as") == F.col("declared"))).withColumn("tier", F.lit(1))
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    beside = names.withColumn("folder", folder("path")).join(
        symbols.where("language in ('python', 'go', 'rust')").withColumn("dir", folder("target")), (F.col("folder") == F.col("dir")) & (F.col("name") == F.col("declared")) & (F.col("path") != F.col("target"))
    ).withColumn("tier", F.lit(2))
    columns = ["path", "name", "tier", "target", "target_ord", "kind", "signature", "body"]
    every = here.select(*columns).unionByName(there.select(*columns)).unionByName(beside.select(*columns))
    return first_per_key(every, ["path", "name"], F.struct("tier", "target", "target_ord"))


def type_closure(facts: DataFrame, links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Types that seeds (query, path, symbol_ord) mention, directly or through each other's definitions.

    Types of the same file come at any depth from 0; ``depth`` bounds the steps. A name is visited once
    per query. Returns query, name, level, target, target_ord, kind, body.
    """
    refs = facts.where("fact = 'ref'").select("path", "symbol_ord", "name")
    frontier = seeds.select("query", "path", "symbol_ord")
    visited = None
    for level in range(depth + 1):
        names = frontier.join(refs, ["path", "symbol_ord"]).select("query", "path", "name").distinct()
        found = names.join(declarations(facts, names.select("path", "name").distinct(), links), ["path", "name"])
        if level == 0 and depth == 0:
            found = found.where("tier = 0")
        found = first_per_key(found.select("query", "name", F.lit(level).alias("level"), "target", "target_ord", "kind", "body"), ["query", "name"], F.struct("target", "target_ord"))
        if visited is not None:
            found = found.join(visited.select("query", "name"), ["query", "name"], "left_anti")
        found = settle(found)
        visited = found if visited is None else visited.unionByName(found)
        frontier = found.select("query", F.col("target").alias("path"), F.col("target_ord").alias("symbol_ord"))
        if level == depth:
            break
    return visited


def call_stubs(facts: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Signatures of what seeds call: a member of the same class, a member of the declared type of the class's
    field, else a declaration by name.

    Unresolved Python calls without a receiver get a stub; others are left out.
    """
    calls = seeds.join(facts.where("fact = 'call'").select("path", "symbol_ord", F.col("ord").alias("call_ord"), "receiver", "name", "language"), ["path", "symbol_ord"])
    own = facts.where("fact = 'symbol'").select("path", F.col("ord").alias("symbol_ord"), F.col("container").alias("owner"))
    calls = calls.join(own, ["path", "symbol_ord"])
    every = facts.where("fact = 'symbol' and container IS NOT NULL").select("path", F.col("container").alias("owner"), "name", F.col("signature").alias("member"), F.col("ord").alias("member_ord"))
    members = first_per_key(every, ["path", "owner", "name"], F.col("member_ord")).drop("member_ord")
    calls = calls.join(members, ["path", "owner", "name"], "left")
    held = facts.where("fact = 'field'").select("path", F.col("container").alias("owner"), F.col("name").alias("receiver"), F.col("imported").alias("type"))
    calls = settle(calls.join(held, ["path", "owner", "receiver"], "left"))
    typed = calls.where("type IS NOT NULL").select("path", F.col("type").alias("name")).distinct()
    places = declarations(facts, typed, links).select("path", F.col("name").alias("type"), F.col("target").alias("at"), F.col("name").alias("declared_as"))
    of_field = places.join(members.select(F.col("path").alias("at"), F.col("owner").alias("declared_as"), "name", F.col("member").alias("of_field")), ["at", "declared_as"]).select("path", "type", "name", "of_field")
    calls = calls.join(of_field, ["path", "type", "name"], "left")
    direct = declarations(facts, calls.select("path", "name").distinct(), links).select("path", "name", F.col("signature").alias("declared"))
    calls = calls.join(direct, ["path", "name"], "left")
    mine = F.when(F.col("receiver").isin("this", "self"), F.col("member"))
    stub = F.when((F.col("language") == "python") & F.col("receiver").isNull(), F.concat(F.lit("def "), F.col("name"), F.lit("(*args, **kwargs): ...")))
    out = calls.withColumn("signature", F.coalesce(mine, F.col("of_field"), F.when(F.col("receiver").isNull() | F.col("member").isNull(), F.col("declared")), stub)).where("signature IS NOT NULL")
    return first_per_key(out.select("query", "receiver", "name", "call_ord", "signature"), ["query", "receiver", "name"], F.struct("call_ord", "signature"))
