"""Imports of languages that name packages, namespaces or modules in place of paths.

Each language's rule is a set of equi-joins of its imports with keys that files declare:

* Java, Kotlin: ``package.Type`` reaches the type, ``package.*`` every file of the package.
* C#: a namespace reaches every file that declares it.
* Swift: a module is the folder below ``Sources``, else the file's own folder.
* Go: below the module path of the nearest go.mod, a package is a folder and reaches its files but tests.
* Rust: ``crate``, ``self`` and ``super`` paths become candidate files below the nearest Cargo.toml.
* C, C++: an include reaches the header and the implementation files of its name beside it.

An import that names a symbol points at it if the file exports it, else at the file; no file reaches itself.
Specifiers that no file of the tree answers to are external and give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import dirname
from quarrystone.operators.graph import nearest_ancestor
from quarrystone.operators.resolve import normalised

HEADERS = ("h", "hh", "hpp", "hxx")
BODIES = ("c", "cc", "cpp", "cxx")
TYPES = ("class", "interface", "struct", "enum", "type")
_EMPTY_ROOTS = "kind string, folder string, module string"


def roots(manifests: DataFrame) -> DataFrame:
    """(kind, folder, module) of Cargo.toml and go.mod files, given as (file, content); folders end with / and the root's is empty."""
    name = F.regexp_extract("file", "([^/]*)$", 1)
    kind = F.when(name == "Cargo.toml", "cargo").when(name == "go.mod", "go")
    module = F.regexp_extract("content", r"(?m)^[ \t]*module[ \t]+([^ \t\r\n]+)", 1)
    return manifests.select(kind.alias("kind"), F.regexp_replace("file", "[^/]*$", "").alias("folder"), F.when(kind == "go", module).alias("module")).where("kind is not null")


def declared(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, key, file, whole): packages, namespaces and modules (whole) and the types in them."""
    package = F.regexp_extract("content", r"(?m)^[ \t]*package[ \t]+([A-Za-z0-9_.]+)", 1)
    spaces = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*namespace[ \t]+([A-Za-z0-9_.]+)"), 1))
    steps = F.split("file", "/")
    # the last folder called Sources that has a folder below it
    below = F.regexp_extract("file", "^(?:.*/)?Sources/([^/]+)/[^/]*(?:/[^/]*)*$", 1)
    module = F.when(below != "", below).when(F.size(steps) > 1, F.element_at(steps, -2))
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    keys = F.when(F.col("language").isin("java", "kotlin"), one(package)).when(F.col("language") == "csharp", spaces).when(F.col("language") == "swift", one(module))
    groups = sources.where(F.col("language").isin("java", "kotlin", "csharp", "swift")).select("language", "file", F.explode(keys).alias("key"))
    types = symbols.where(F.col("parent_id").isNull() & F.col("kind").isin(*TYPES)).select("file", "name")
    named = groups.where(F.col("language").isin("java", "kotlin")).join(types, "file").select("language", F.concat_ws(".", "key", "name").alias("key"), "file", F.lit(False).alias("whole"))
    return groups.select("language", "key", "file", F.lit(True).alias("whole")).unionByName(named).distinct()


def _keyed(imports: DataFrame, keys: DataFrame) -> DataFrame:
    """Java, Kotlin, C# and Swift."""
    rows = imports.where(F.col("language").isin("java", "kotlin", "csharp", "swift"))
    whole = (F.col("symbol") == "*") | F.col("language").isin("csharp", "swift")
    return rows.select("language", "file", "symbol", F.col("from_spec").alias("key"), whole.alias("whole")).join(keys.withColumnRenamed("file", "target"), ["language", "key", "whole"]).select("file", "symbol", "target", "whole")


def _go(imports: DataFrame, files: DataFrame, marks: DataFrame) -> DataFrame:
    rows = imports.where("language = 'go'").select("file", "from_spec")
    near = nearest_ancestor(rows.select("file").distinct(), marks).join(marks.select(F.col("folder").alias("marker"), "module"), "marker")
    rest = F.substr(F.col("from_spec"), F.length("module") + 1)
    inside = (F.col("from_spec") == F.col("module")) | F.startswith(F.col("from_spec"), F.concat("module", F.lit("/")))
    folder = F.regexp_replace(F.concat(F.regexp_replace("marker", "/$", ""), rest), "^/", "")
    packages = files.where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go")).select(F.regexp_replace("file", "/?[^/]*$", "").alias("folder"), F.col("file").alias("target"))
    return rows.join(near, "file").where(inside).select("file", folder.alias("folder")).join(packages, "folder").select("file", F.lit("*").alias("symbol"), "target", F.lit(True).alias("whole"))


def _candidates(rows: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """The first of each row's candidate files that exists."""
    listed = rows.select("file", "symbol", "from_spec", F.posexplode(candidates).alias("p", "cand")).where("cand is not null")
    return listed.join(files.select(F.col("file").alias("cand")).distinct(), "cand").groupBy("file", "symbol", "from_spec").agg(F.min_by("cand", "p").alias("target"))


def _rust(imports: DataFrame, files: DataFrame, marks: DataFrame) -> DataFrame:
    rows = imports.where("language = 'rust'").select("file", "symbol", "from_spec").distinct()
    rows = rows.join(nearest_ancestor(rows.select("file").distinct(), marks), "file")
    steps = F.split("from_spec", "::")
    # folders that hold sources: a crate's src counts if any file is in it
    src = files.where(F.contains("file", F.lit("src/"))).select(F.regexp_extract("file", "^(.*?)src/", 1).alias("marker")).distinct().withColumn("__src", F.lit(True))
    rows = rows.join(src, "marker", "left")
    up = F.size(F.filter(steps, lambda s: s == "super"))
    own = F.when(dirname(F.col("file")) == ".", "").otherwise(dirname(F.col("file")))
    head = F.element_at(steps, 1)
    base = F.when((head == "crate") & F.col("marker").isNotNull(), F.concat("marker", F.when(F.col("__src"), "src").otherwise("")))
    base = base.when(head == "self", own).when(head == "super", F.concat(own, F.repeat(F.lit("/.."), up)))
    rest = F.when(head == "super", F.slice(steps, up + 1, F.greatest(F.size(steps) - up, F.lit(0)))).otherwise(F.slice(steps, F.lit(2), F.size(steps) - 1))
    at = normalised(F.concat_ws("/", base, F.array_join(rest, "/")))
    below = lambda x: F.when(at == "", F.lit(x)).otherwise(F.concat(at, F.lit("/" + x)))
    named = F.array(F.concat(at, F.lit(".rs")), below("mod.rs"))
    bare = F.array(below("mod.rs"), below("lib.rs"), below("main.rs"), F.concat(at, F.lit(".rs")))
    hit = _candidates(rows.where(base.isNotNull()), files, F.when(F.size(rest) > 0, named).otherwise(bare))
    return hit.select("file", "symbol", "target", F.col("symbol").isin("*", "self").alias("whole"))


def _includes(imports: DataFrame, files: DataFrame) -> DataFrame:
    rows = imports.where(F.col("language").isin("c", "cpp")).select("file", "from_spec").distinct()
    own = F.when(dirname(F.col("file")) == ".", "").otherwise(dirname(F.col("file")))
    header = rows.select("file", normalised(F.concat_ws("/", own, "from_spec")).alias("target")).where("target is not null").join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    stem = F.regexp_extract("target", rf"^(.*)[.](?:{'|'.join(HEADERS)})$", 1)
    body = header.where(stem != "").select("file", F.explode(F.array(*(F.concat(stem, F.lit("." + x)) for x in BODIES))).alias("target")).join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    return header.unionByName(body).select("file", F.lit("*").alias("symbol"), "target", F.lit(True).alias("whole"))


def targets(imports: DataFrame, sources: DataFrame, symbols: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(file, symbol, target, whole): the files that imports of these languages reach; ``whole`` where no symbol is named.

    ``sources(file, language, content)``; ``marks`` come from ``roots``.
    """
    files = sources.select("file", "language")
    spoken = imports.where("not is_side_effect").join(files, "file")
    if marks is None:
        marks = sources.sparkSession.createDataFrame([], _EMPTY_ROOTS)
    parts = [_keyed(spoken, declared(sources, symbols)), _go(spoken, files, marks.where("kind = 'go'")), _rust(spoken, files, marks.where("kind = 'cargo'")), _includes(spoken, files)]
    return reduce(DataFrame.unionByName, parts).where("file <> target").distinct()


def edges(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): to the exported symbol that is named, else to the file."""
    exported = symbols.where("exported").select(F.col("file").alias("target"), F.col("name").alias("symbol"), "symbol_id").distinct()
    named = found.where("not whole").join(exported, ["target", "symbol"], "left").select(F.col("file").alias("src"), F.coalesce("symbol_id", "target").alias("dst"))
    return named.unionByName(found.where("whole").select(F.col("file").alias("src"), F.col("target").alias("dst"))).distinct()
