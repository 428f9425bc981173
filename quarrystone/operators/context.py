"""What surrounds a symbol: its source, what it needs, who needs it; and bundles of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import rating
from quarrystone.operators.delta import symbol_diff


def symbol_source(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """(symbol_id, source): the lines of each symbol, cut from files(file, content)."""
    lines = F.slice(F.split("content", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return symbols.join(contents.select("file", "content"), "file").select("symbol_id", F.array_join(lines, "\n").alias("source"))


def related_types(symbols: DataFrame) -> DataFrame:
    """(symbol_id, type_id): interfaces, types and enums whose names occur in a signature."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce("signature", F.lit("")), F.lit("[A-Z][A-Za-z0-9_]*"), 0))
    wanted = symbols.select("symbol_id", F.explode(names).alias("name"))
    types = symbols.where(F.col("kind").isin("interface", "type", "enum")).select(F.col("symbol_id").alias("type_id"), "name")
    return wanted.join(types, "name").where("symbol_id <> type_id").select("symbol_id", "type_id").distinct()


def explain(symbols: DataFrame, edges: DataFrame, calls: DataFrame, complexity: DataFrame, name: str) -> DataFrame:
    """One row for each symbol of that name: kind, size, callers, callees, children, complexity and rating."""
    s = symbols.where((F.col("qualified_name") == name) | (F.col("name") == name)).select("symbol_id", "file", "qualified_name", "kind", "exported", "signature", "doc", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), F.coalesce(F.col("signature").contains("async "), F.lit(False)).alias("is_async"))
    top = lambda c, k: F.array_join(F.slice(F.sort_array(F.collect_set(c)), 1, k), ",")
    callers = edges.groupBy(F.col("dst").alias("symbol_id")).agg(top("src", 20).alias("callers"))
    callees = calls.groupBy("file", F.col("caller").alias("qualified_name")).agg(top("callee", 10).alias("depends_on"))
    children = symbols.groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n_children"))
    c = complexity.select("symbol_id", "complexity")
    out = s.join(callers, "symbol_id", "left").join(callees, ["file", "qualified_name"], "left").join(children, "symbol_id", "left").join(c, "symbol_id", "left")
    return out.na.fill(0, ["n_children"]).withColumn("rating", rating(F.col("complexity")))


def context_pack(symbols: DataFrame, contents: DataFrame, edges: DataFrame, file_edges: DataFrame, symbol_id: str) -> DataFrame:
    """(part, item, text, tokens): a symbol's source, the signatures of what its file imports, and its dependents; a token is four signs."""
    own = symbols.where(F.col("symbol_id") == symbol_id)
    source = symbol_source(own, contents).select(F.lit("source").alias("part"), F.col("symbol_id").alias("item"), F.col("source").alias("text"))
    needs = file_edges.join(own.select(F.col("file").alias("src")), "src", "left_semi").select(F.col("dst").alias("file")).distinct()
    deps = symbols.where("exported").join(needs, "file", "left_semi").select(F.lit("dependency").alias("part"), F.col("symbol_id").alias("item"), F.coalesce("signature", "name").alias("text"))
    users = edges.where(F.col("dst") == symbol_id).select(F.lit("dependent").alias("part"), F.col("src").alias("item"), F.col("src").alias("text")).distinct()
    return source.unionByName(deps).unionByName(users).withColumn("tokens", F.round(F.length("text") / 4).cast("int"))


def pr_analysis(old: DataFrame, new: DataFrame, findings: DataFrame, changed: DataFrame, limit: int = 50) -> DataFrame:
    """(part, file, what): symbol changes and the findings of changed files, at most ``limit`` of each part (a report)."""
    d = symbol_diff(old, new, ["file", "qualified_name"]).select(F.col("change").alias("part"), "file", F.col("qualified_name").alias("what")).orderBy("file", "what").limit(limit)
    f = findings.join(changed.select("file").distinct(), "file", "left_semi").select(F.lit("finding").alias("part"), "file", F.concat_ws(" ", "rule", F.col("line_no").cast("string")).alias("what")).orderBy("file", "what").limit(limit)
    return d.unionByName(f)


_SERVER = ("fs", "net", "tls", "http2", "child_process", "worker_threads", "next/headers", "server-only")


def server_in_client(contents: DataFrame, imports: DataFrame) -> DataFrame:
    """Server-side imports in files that start with the client directive: (file, from_spec)."""
    client = contents.where(F.substring("content", 1, 500).rlike("['\"]use client['\"]")).select("file")
    bare = F.regexp_replace("from_spec", "^node:", "")
    return imports.join(client, "file", "left_semi").where(bare.isin(*_SERVER) | F.col("from_spec").rlike("(^|/)server(/|$)|[.]server$")).select("file", "from_spec").distinct()


def unguarded_routes(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """Handlers of API routes without a try block: (file, symbol_id)."""
    routes = symbols.where(F.col("file").rlike("(^|/)(app|pages)/.*(route|api/.*)[.][cm]?[jt]sx?$") & F.col("name").isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "handler"))
    return routes.join(symbol_source(routes, contents), "symbol_id").where(~F.col("source").rlike(r"(^|[^A-Za-z0-9_])try\s*[{]")).select("file", "symbol_id")


Plugin = Callable[..., DataFrame]


def run_plugins(plugins: dict[str, Plugin], *relations) -> DataFrame | None:
    """(plugin, file, rule, message, error): what each plugin finds; one that fails gives its error and stops no other.

    A plugin gets the relations and returns a DataFrame with file, rule and message.
    """
    out = None
    for name, run in sorted(plugins.items()):
        try:
            df = run(*relations).select(F.lit(name).alias("plugin"), "file", "rule", "message", F.lit(None).cast("string").alias("error"))
            df.schema  # noqa: B018
        except Exception as e:  # a plugin is foreign code; its failure is a result
            spark = relations[0].sparkSession
            df = spark.createDataFrame([(name, None, None, None, f"{type(e).__name__}: {e}"[:300])], "plugin string, file string, rule string, message string, error string")
        out = df if out is None else out.unionByName(df)
    return out
