"""From import specifiers to files: candidates in order of preference, joined to the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import dirname

_SUFFIXES = ("", *("." + x for x in "ts tsx mts cts js jsx mjs cjs vue svelte py pyi rb h hpp".split()), *("/index." + x for x in "ts tsx js jsx mjs".split()), "/__init__.py", "/mod.rs", ".rs", ".go", ".php")


def normalised(path: Column) -> Column:
    """A path without . and .. steps; null if it climbs above the root."""
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(x == "..", F.lit(None).cast("array<string>")).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def resolve(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = (), packages: DataFrame | None = None) -> DataFrame:
    """``imports`` with target (a file or null) and origin (relative, alias, workspace, external).

    Relative specifiers start at the importing file's folder; ``aliases`` are (prefix, replacement)
    pairs of which the longest matching one counts; ``packages(name, dir)`` are workspace packages.
    A compiled suffix (.js) also stands for its source (.ts).  Python's absolute modules are
    tried from the root.  Among existing candidates the earliest kind wins.
    """
    spec = F.col("from_spec")
    relative = spec.startswith("./") | spec.startswith("../") | spec.isin(".", "..")
    base = F.when(relative, F.concat_ws("/", F.when(dirname(F.col("file")) == ".", F.lit("")).otherwise(dirname(F.col("file"))), spec))
    origin = F.when(relative, "relative")
    for prefix, replacement in sorted(aliases, key=lambda x: -len(x[0])):
        hit = spec.startswith(prefix)
        base = F.when(base.isNull() & hit, F.concat(F.lit(replacement), F.substr(spec, F.lit(len(prefix) + 1)))).otherwise(base)
        origin = F.when(origin.isNull() & hit, "alias").otherwise(origin)
    rows = imports.withColumn("__base", base).withColumn("__origin", origin)
    if packages is not None:
        top = F.when(spec.startswith("@"), F.regexp_extract(spec, "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(spec, "^([^/]+)", 1))
        named = packages.select(F.col("name").alias("__pkg"), F.col("dir").alias("__dir"))
        rows = rows.withColumn("__pkg", top).join(named, "__pkg", "left")
        rest = F.substr(spec, F.length("__pkg") + 1)
        inside = F.col("__base").isNull() & F.col("__dir").isNotNull()
        rows = rows.withColumn("__base", F.when(inside & (rest == ""), F.concat("__dir", F.lit("/src/index"))).when(inside, F.concat("__dir", rest)).otherwise(F.col("__base")))
        rows = rows.withColumn("__origin", F.when(inside, "workspace").otherwise(F.col("__origin"))).drop("__pkg", "__dir")
    module = F.col("file").rlike("[.]pyi?$") & F.col("__base").isNull()
    dotted = F.translate(spec, ".", "/")
    rows = rows.withColumn("__base", F.coalesce(normalised(F.col("__base")), F.when(module, dotted)))
    stem = F.regexp_replace("__base", "[.][cm]?jsx?$", "")
    # `from package import module`: the name may itself be a file below the specifier
    cands = [F.when(F.col("file").rlike("[.]pyi?$"), F.concat("__base", F.lit("/"), "symbol", F.lit(".py")))]
    cands += [F.concat("__base", F.lit(s)) for s in _SUFFIXES] + [F.concat(stem, F.lit(s)) for s in (".ts", ".tsx")]
    listed = rows.where("__base is not null").select("file", "ordinal", F.posexplode(F.array(*cands)).alias("p", "cand"))
    hit = listed.join(files.select(F.col("file").alias("cand")).distinct(), "cand").groupBy("file", "ordinal").agg(F.min_by("cand", "p").alias("target"))
    out = rows.join(hit, ["file", "ordinal"], "left")
    kind = F.when(F.col("__origin").isNotNull(), F.col("__origin")).when(F.col("target").isNotNull(), "module").otherwise("external")
    return out.select(*imports.columns, "target", kind.alias("origin"))


def package_links(imports: DataFrame, keys: DataFrame) -> DataFrame:
    """(src, dst): imports of a package, namespace or module reach every file that declares it, but not their own.

    ``keys(key, file)`` says which file declares which key.
    """
    k = keys.select(F.col("key").alias("from_spec"), F.col("file").alias("dst")).distinct()
    return imports.select(F.col("file").alias("src"), "from_spec").distinct().join(k, "from_spec").where("src <> dst").select("src", "dst").distinct()


def enrich(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved imports with the imported symbol's kind, signature and whether it was found."""
    s = symbols.where("parent_id is null").select(F.col("file").alias("target"), F.col("name").alias("symbol"), "kind", "signature").dropDuplicates(["target", "symbol"])
    return resolved.join(s, ["target", "symbol"], "left").withColumn("found", F.col("kind").isNotNull())
