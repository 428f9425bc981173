"""Operators over the symbol graph.

Canonical inputs (names can be changed by renaming columns first):
``files(file)``, ``symbols(symbol_id, file, name, kind, exported)``,
``edges(src, dst)`` from an importing file to an imported symbol or file, and
``file_edges(src, dst)``, its distinct projection to files.

Every operator is one declarative plan: equi-joins and partial aggregations that AQE may
broadcast or split.  The two iterative ones (``impact`` and ``cyclic_core``) cut their
lineage with a written table each round, so a lost executor costs a reread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import rounded
from quarrystone.operators.components import components, forest
from quarrystone.session import discard, materialize, ship

#: Kinds that are only ever used through an explicit import.
CERTAIN_KINDS = ("function", "class", "method", "const", "var")


def file_edges(edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) file pairs; a dst that is a symbol id becomes the file that owns it."""
    if symbols is None:
        return edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    owner = symbols.select(F.col("symbol_id").alias("dst"), F.col("file").alias("__file"))
    joined = edges.join(owner, "dst", "left")
    return joined.select("src", F.coalesce("__file", "dst").alias("dst")).where("src <> dst").distinct()


def wire_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) edges of imports whose file and name are an exported symbol; namespace imports point at the file."""
    exported = symbols.where("exported").select(F.col("file").alias("target"), F.col("name").alias("symbol"), "symbol_id").distinct()
    named = imports.where("not is_namespace and target is not null").join(exported, ["target", "symbol"]).select(F.col("file").alias("src"), F.col("symbol_id").alias("dst"))
    whole = imports.where("is_namespace and target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst"))
    return named.unionByName(whole).distinct()


def graph_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, symbols and edges."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(files, "n_files").crossJoin(n(symbols, "n_symbols")).crossJoin(n(edges, "n_edges"))


def dead_exports(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported symbols that no edge points at, with a confidence by kind."""
    confidence = F.when(F.col("kind").isin(*CERTAIN_KINDS), "high").otherwise("low")
    return symbols.where("exported").join(edges.select(F.col("dst").alias("symbol_id")), "symbol_id", "left_anti").select("file", "symbol_id", "name", "kind", confidence.alias("confidence"))


def orphan_types(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Dead exports that are types or interfaces."""
    return dead_exports(symbols.where(F.col("kind").isin("type", "interface")), edges)


def api_surface(symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """Exported symbols by file: their number and sorted names."""
    rows = symbols.where("exported") if kind is None else symbols.where(F.col("exported") & (F.col("kind") == kind))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_exported"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def top_symbols(edges: DataFrame, symbols: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` symbols imported by most files; ties by id."""
    counted = edges.groupBy(F.col("dst").alias("symbol_id")).agg(F.count_distinct("src").alias("import_count"))
    return counted.join(symbols.select("symbol_id", "file", "kind"), "symbol_id").orderBy(F.desc("import_count"), "symbol_id").limit(k)


def coupling(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, ca, ce, instability) of every file; ``edges`` must be distinct file pairs."""
    ends = edges.select(F.col("src").alias("file"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("file"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    every = ends.unionByName(files.select("file", F.lit(0).alias("out"), F.lit(0).alias("into")))
    degrees = every.groupBy("file").agg(F.sum("into").alias("ca"), F.sum("out").alias("ce"))
    return degrees.select("file", "ca", "ce", instability(F.col("ca"), F.col("ce")).alias("instability"))


def instability(ca: Column, ce: Column) -> Column:
    return F.when(ca + ce > 0, rounded(ce / (ca + ce), 2)).otherwise(0.0)


def module_coupling(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """(module, n_files, ca, ce, weight_in, weight_out, instability).

    ``edges`` are import edges, each counted in the weights; ``module_of`` maps file to module.
    Edges within a module are ignored.
    """
    a, b = module_of.select(F.col("file").alias("src"), F.col("module").alias("m_src")), module_of.select(F.col("file").alias("dst"), F.col("module").alias("m_dst"))
    between = edges.join(a, "src").join(b, "dst").where("m_src <> m_dst").groupBy("m_src", "m_dst").agg(F.count(F.lit(1)).alias("weight"))
    out = between.groupBy(F.col("m_src").alias("module")).agg(F.count(F.lit(1)).alias("ce"), F.sum("weight").alias("weight_out"))
    into = between.groupBy(F.col("m_dst").alias("module")).agg(F.count(F.lit(1)).alias("ca"), F.sum("weight").alias("weight_in"))
    sized = module_of.groupBy("module").agg(F.count_distinct("file").alias("n_files"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = sized.join(out, "module", "left").join(into, "module", "left").select("module", "n_files", z("ca"), z("ce"), z("weight_in"), z("weight_out"))
    return joined.withColumn("instability", instability(F.col("ca"), F.col("ce")))


def module_edges(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """(src_module, dst_module, weight) between different modules."""
    a, b = module_of.select(F.col("file").alias("src"), F.col("module").alias("src_module")), module_of.select(F.col("file").alias("dst"), F.col("module").alias("dst_module"))
    return edges.join(a, "src").join(b, "dst").where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("weight"))


def layer_violations(edges: DataFrame, coupled: DataFrame, min_gap: float = 0.0) -> DataFrame:
    """Edges from a stabler file to a less stable one: severity = the difference of instability."""
    a = coupled.select(F.col("file").alias("src"), F.col("instability").alias("i_src"))
    b = coupled.select(F.col("file").alias("dst"), F.col("instability").alias("i_dst"))
    rows = edges.join(a, "src").join(b, "dst").withColumn("severity", rounded(F.col("i_dst") - F.col("i_src"), 2))
    return rows.where(F.col("severity") > min_gap).select("src", "dst", "i_src", "i_dst", "severity")


def file_deps(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """For every pair of files with an edge, the sorted distinct symbols that are imported."""
    owner = symbols.select(F.col("symbol_id").alias("dst"), F.col("file").alias("__file"), F.col("name").alias("__name"))
    rows = edges.join(owner, "dst", "left").select("src", F.coalesce("__file", "dst").alias("dst"), "__name").where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("__name")), ",").alias("symbols"))


def duplicates(symbols: DataFrame, at_least: int = 2) -> DataFrame:
    """Exported names defined in at least ``at_least`` files, with the sorted files."""
    grouped = symbols.where("exported").groupBy("name").agg(F.count_distinct("file").alias("n_files"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"))
    return grouped.where(F.col("n_files") >= at_least)


def impact(edges: DataFrame, seeds: DataFrame, stored: bool = False) -> DataFrame:
    """(seed, file, distance) of everything that reaches ``seeds(seed, file)`` against the edges.

    A semi-naive reverse closure for any number of seeds at once: each round joins the
    frontier only, and drops what was reached before.  Distance 1 is direct.  Edges may be repeated.
    They are written once and reread each round, unless they are ``stored``: columns of a table, cheap to read.
    """
    spark, kept = edges.sparkSession, None
    back = edges.select(F.col("dst").alias("file"), F.col("src").alias("next")).where("file is not null and next is not null")
    if not stored:
        back, kept = materialize(back.distinct(), "edges")
    frontier, path = materialize(seeds.select("seed", "file", F.lit(0).alias("distance")).distinct(), "impact")
    reached, paths = frontier, [path]
    for step in count(1):
        found = frontier.join(back, "file").select("seed", F.col("next").alias("file")).distinct()
        new = found.join(reached.select("seed", "file"), ["seed", "file"], "left_anti").select("seed", "file", F.lit(step).alias("distance"))
        frontier, path = materialize(new, "impact")
        if frontier.isEmpty():
            discard(spark, path)
            break
        paths.append(path)
        reached = spark.read.schema(frontier.schema).parquet(*paths)
    if kept is not None:
        discard(spark, kept)
    return reached.where("distance > 0")


def linked(edges: DataFrame, seeds: DataFrame, named=lambda c: c) -> DataFrame:
    """(seed, file) of everything that reaches ``seeds(seed, file)`` over edges (src, dst) that all go both ways.

    Nodes are whole numbers, and each edge is given once, either way.  What reaches a seed is then its connected
    component, so rounds handle nodes, not pairs of seed and file; these are one join at the end.
    ``named`` turns a node into its name.
    """
    parts, _ = materialize(components(forest(edges, "src", "dst")), "linked")
    parts = parts.withColumnRenamed("node", "file")
    own, _ = materialize(seeds.join(parts, "file").select("seed", "component").distinct(), "seeds")
    members = parts.select(named(F.col("file")).alias("file"), "component")
    return members.join(own, "component").where("file <> seed").select("seed", "file")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when files without incoming or outgoing edges are peeled off until none is left."""
    spark = edges.sparkSession
    now, path = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "core")
    while True:
        ends = now.select(F.col("src").alias("file"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("dst").alias("file"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        loose, loose_path = materialize(ends.groupBy("file").agg(F.max("out").alias("out"), F.max("into").alias("into")).where("out = 0 or into = 0").select("file"), "loose")
        if loose.isEmpty():
            discard(spark, loose_path)
            return now
        now, new = materialize(now.join(loose.withColumnRenamed("file", "src"), "src", "left_anti").join(loose.withColumnRenamed("file", "dst"), "dst", "left_anti").select("src", "dst"), "core")
        discard(spark, path)
        discard(spark, loose_path)
        path = new


def elementary_cycles(edges: DataFrame, max_length: int = 3, named=lambda c: c) -> DataFrame:
    """(cycle, length): every elementary cycle of at most ``max_length`` files, each once.

    A cycle is written from its least file, closed, joined by ' > '.  Paths start at the
    least file and only visit greater ones, so each cycle is found once and no closure is needed.
    Files may be numbers, which are compared as such while paths grow; ``named`` turns one into its name.
    """
    return _elementary(cyclic_core(edges), max_length, named)


def _elementary(core: DataFrame, max_length: int, named) -> DataFrame:
    step = core.select(F.col("src").alias("__at"), F.col("dst").alias("__to"))
    paths = core.where("src < dst").select(F.col("src").alias("root"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found = paths.join(core.select(F.col("src").alias("at"), F.col("dst").alias("root")), ["at", "root"], "left_semi").select("path") if max_length >= 2 else paths.where("false").select("path")
    for n in range(3, max_length + 1):
        if n == max_length:
            closed = _closed_by_lists(core, paths)
        else:
            wider = paths.join(step, paths["at"] == step["__at"]).where((F.col("__to") > F.col("root")) & ~F.array_contains("path", F.col("__to")))
            paths = wider.select("root", F.col("__to").alias("at"), F.concat("path", F.array("__to")).alias("path"))
            closed = paths.join(core.select(F.col("src").alias("at"), F.col("dst").alias("root")), ["at", "root"], "left_semi").select("path")
        found = found.unionByName(closed)
    names = found.select(F.transform("path", lambda c: named(c)).alias("f")).withColumn("k", F.array_position("f", F.array_min("f")).cast("int"))
    turned = names.select(F.concat(F.slice("f", F.col("k"), F.size("f")), F.slice("f", F.lit(1), F.col("k"))).alias("f"))
    return turned.select(F.array_join("f", " > ").alias("cycle"), (F.size("f") - 1).alias("length"))


def _closed_by_lists(core: DataFrame, paths: DataFrame) -> DataFrame:
    """(path): ``paths(root, at, path)`` with one more file, from which an edge leads back to the root.

    That file is in what imports the root and in what the path's end imports.  Both are lists, so a path is one row
    that meets its two lists, and the longest paths, most of which don't close, are never rows.
    """
    into, out = _lists(core.where("src > dst"), "dst", "src"), _lists(core, "src", "dst")
    held = paths.join(into.select(F.col("key").alias("root"), F.col("list").alias("into")), "root").select("at", "path", "into")
    last = held.join(out.select(F.col("key").alias("at"), F.col("list").alias("out")), "at").select("path", F.explode(F.array_intersect("into", "out")).alias("x"))
    return last.where(~F.array_contains("path", F.col("x"))).select(F.concat("path", F.array("x")).alias("path"))


def _lists(edges: DataFrame, key: str, value: str) -> DataFrame:
    """(key, list): the values of each key in lists of at most an Arrow batch's rows; a key may have several."""
    ship(edges.sparkSession)
    kind = edges.schema[key].dataType.simpleString()
    return edges.select(key, value).repartition(key).sortWithinPartitions(key).mapInArrow(_gather, f"key {kind}, list array<{kind}>")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, value = batch.column(0), batch.column(1)
        new = pc.not_equal(key.slice(1), key.slice(0, max(len(key) - 1, 0))).to_numpy(zero_copy_only=False)
        starts = np.concatenate([np.zeros(min(len(key), 1), "int32"), np.flatnonzero(new) + 1]).astype("int32")
        bounds = pa.array(np.append(starts, len(key)).astype("int32"))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(starts)), pa.ListArray.from_arrays(bounds, value)], ["key", "list"])


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(component, file) of every strongly connected component of at least two files, whatever the length of its cycles.

    ``component`` is its least file.  The least label is sent along the edges until nothing changes.  A file whose label
    is its own is the least of its component, which is what reaches it against the edges between files of that label:
    there each file is reached once.  Edges that leave a label or a component are dropped; what remains is peeled and done again.
    """
    return _groups(cyclic_core(edges))


def _groups(core: DataFrame) -> DataFrame:
    spark, found, rest = core.sparkSession, None, core
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("file")).unionByName(rest.select(F.col("dst").alias("file"))).distinct()
        labels = _least_reaching(nodes, rest)
        a = labels.select(F.col("file").alias("src"), F.col("label").alias("a"))
        b = labels.select(F.col("file").alias("dst"), F.col("label").alias("b"))
        within, within_path = materialize(rest.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"), "within")
        roots = labels.where("file = label").select(F.col("file").alias("seed"), "file")
        # within a label only its own root is reached, so a file occurs once
        done, _ = materialize(roots.unionByName(impact(within, roots, stored=True).where("file <> seed").select("seed", "file")).withColumnRenamed("seed", "component"), "labels")
        found = done if found is None else found.unionByName(done)
        off = lambda c: done.select(F.col("file").alias(c))
        rest = cyclic_core(within.join(off("src"), "src", "left_anti").join(off("dst"), "dst", "left_anti"))
        discard(spark, within_path)
    if found is None:
        kind = core.schema["src"].dataType.simpleString()
        return spark.createDataFrame([], f"component {kind}, file {kind}")
    sized = found.groupBy("component").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("component")
    return found.join(sized, "component", "left_semi")


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, label): the least file among those that reach each file, itself included."""
    now, path = materialize(nodes.select("file", F.col("file").alias("label")), "least")
    frontier = now
    while True:
        sent = frontier.join(edges, frontier["file"] == edges["src"]).groupBy(F.col("dst").alias("file")).agg(F.min("label").alias("new"))
        joined = now.join(sent, "file", "left")
        nxt, new_path = materialize(joined.select("file", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("less")), "least")
        discard(edges.sparkSession, path)
        now, path = nxt.select("file", "label"), new_path
        frontier = nxt.where("less").select("file", "label")
        if frontier.isEmpty():
            return now


def long_cycles(edges: DataFrame, max_length: int, named=lambda c: c) -> DataFrame:
    """(cycle, length): one row for every strongly connected component of more than ``max_length`` files: its sorted files and their number.

    A longer cycle needs such a component; one may be without it, as a chain of mutual imports is.
    """
    return _long(cyclic_core(edges), max_length, named)


def _long(core: DataFrame, max_length: int, named) -> DataFrame:
    groups = _groups(core).groupBy("component").agg(F.sort_array(F.collect_list(named(F.col("file")))).alias("f")).where(F.size("f") > max_length)
    return groups.select(F.concat(F.lit("component: "), F.array_join("f", ", ")).alias("cycle"), F.size("f").alias("length"))


def all_cycles(edges: DataFrame, max_length: int, named=lambda c: c) -> DataFrame:
    """``elementary_cycles`` and ``long_cycles`` of one core: a graph with any cycle has at least one row."""
    core = cyclic_core(edges)
    return _elementary(core, max_length, named).unionByName(_long(core, max_length, named))


def arch_rules(edges: DataFrame, rules: list[dict], src: str = "src", dst: str = "dst") -> DataFrame:
    """Violations of glob rules.

    A rule has ``id``, ``from`` and either ``forbid`` (no matching file may import a file
    that matches it) or ``require`` (every matching importer needs one import that matches).
    Rules are few and become predicates; a file without imports is never checked.
    """
    out = None
    for rule in rules:
        own = edges.where(F.col(src).rlike(glob_regex(rule["from"])))
        if "forbid" in rule:
            bad = own.where(F.col(dst).rlike(glob_regex(rule["forbid"]))).select(F.col(src).alias("file"), F.col(dst).alias("target"))
        else:
            has = F.max(F.col(dst).rlike(glob_regex(rule["require"])).cast("int"))
            bad = own.groupBy(F.col(src).alias("file")).agg(has.alias("__has")).where("__has = 0").select("file", F.lit(None).cast("string").alias("target"))
        bad = bad.distinct().select(F.lit(rule["id"]).alias("rule"), "file", "target")
        out = bad if out is None else out.unionByName(bad)
    if out is None:
        return edges.sparkSession.createDataFrame([], "rule string, file string, target string")
    return out


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a path glob: ** crosses folders, * and ? do not."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_-" else "\\" + c
        k += 1
    return f"^{out}$"


def call_graph(calls: DataFrame, imports: DataFrame, symbols: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(file, caller, callee, origin, target): where each called name comes from.

    A name is local if the file defines it, else imported if the file imports it or, by ``whole(src, dst)``,
    if a file that it imports as a whole exports the name (the least such file); else unknown.
    """
    local = symbols.select("file", F.col("name").alias("callee"), F.lit(True).alias("__local")).distinct()
    brought = imports.select("file", F.coalesce("alias", "symbol").alias("callee"), F.col("target").alias("__target")).groupBy("file", "callee").agg(F.min("__target").alias("__target"), F.lit(True).alias("__brought"))
    rows = calls.select("file", "caller", "callee").distinct().join(local, ["file", "callee"], "left").join(brought, ["file", "callee"], "left")
    if whole is None:
        rows = rows.withColumn("__near", F.lit(None).cast("string"))
    else:
        offered = symbols.where(F.coalesce("exported", F.col("visibility") == "public")).select(F.col("file").alias("dst"), F.col("name").alias("callee")).distinct()
        near = calls.select("file", "callee").distinct().join(whole.select(F.col("src").alias("file"), "dst").distinct(), "file").join(offered, ["dst", "callee"]).groupBy("file", "callee").agg(F.min("dst").alias("__near"))
        rows = rows.join(near, ["file", "callee"], "left")
    origin = F.when(F.col("__local"), "local").when(F.col("__brought") | F.col("__near").isNotNull(), "import").otherwise("unknown")
    target = F.when(F.col("__local"), F.col("file")).otherwise(F.coalesce("__target", "__near"))
    return rows.select("file", "caller", "callee", origin.alias("origin"), target.alias("target"))


def called_by(graph: DataFrame) -> DataFrame:
    """(file, name, n_callers, callers): of every called name with a known file, who calls it, as file:caller."""
    who = F.concat_ws(":", "file", "caller")
    return graph.where("target is not null").groupBy(F.col("target").alias("file"), F.col("callee").alias("name")).agg(F.count_distinct(who).alias("n_callers"), F.array_join(F.sort_array(F.collect_set(who)), ",").alias("callers"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """(language, n_files, n_symbols): files by language."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("symbol_count").alias("n_symbols"))


def outline(symbols: DataFrame) -> DataFrame:
    """``symbols`` without signatures and notes."""
    return symbols.drop("signature", "doc")


def nearest_ancestor(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(file, marker): the marker folder nearest above each file, null if none; folders end with /."""
    parts = F.split("file", "/")
    depth = F.sequence(F.lit(0), F.size(parts) - 1)
    above = files.select("file", F.explode(depth).alias("depth")).withColumn("folder", F.concat_ws("/", F.slice(F.split("file", "/"), F.lit(1), F.col("depth")), F.lit("")))
    above = above.withColumn("folder", F.when(F.col("depth") == 0, "").otherwise(F.col("folder")))
    hit = above.join(markers.select(F.col("folder")).distinct(), "folder").groupBy("file").agg(F.max_by("folder", "depth").alias("marker"))
    return files.join(hit, "file", "left").select("file", "marker")


def longest_prefix(values: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(value, prefix): the longest listed prefix of each value (null if none), as an equi-join on the value's prefixes."""
    pos = F.sequence(F.lit(0), F.length("value"))
    listed = values.select("value").distinct().select("value", F.explode(pos).alias("n")).withColumn("prefix", F.expr("substring(value, 1, n)"))
    hit = listed.join(prefixes.select("prefix").distinct(), "prefix").groupBy("value").agg(F.max_by("prefix", "n").alias("prefix"))
    return values.join(hit, "value", "left").select("value", "prefix")


def ranked_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
