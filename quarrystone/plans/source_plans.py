"""Queries of the parsers, resolution, reports and readers over a small source tree, with the rows they must give.

The driver's tables hold no code, so the tree is part of the query and the SQL lists the expected rows.
They were worked out from the sources by hand, not taken from the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import context, graph
from quarrystone.plans.registry import query
from quarrystone.project import Project
from quarrystone.session import scratch_path
from quarrystone.sinks import render
from quarrystone.sources import manifests
from quarrystone.sources.languages import language_of

FILES: dict[str, str] = {
    "web/store.ts": """// Keeps the goods.
export class Store {
  private goods: string[] = [];
  add(name: string, count: number): void {
    if (count > 0 && name) {
      this.goods.push(name);
    }
  }
}
export const LIMIT = 9;
export function unused() { return 1; }
""",
    "web/cart.ts": """import { Store, LIMIT } from './store';
import * as tax from '@lib/tax';
import React from 'react';
export async function fill(store: Store, spare: number) {
  store.add('pear', LIMIT);
  return tax.rate(2);
}
""",
    "lib/tax.ts": """export function rate(n: number): number {
  return n > 1 ? n * 2 : n;
}
""",
    "app/api/goods/route.ts": """import { fill } from '../../../web/cart';
export async function GET() {
  return fill(null, 1);
}
export async function POST() {
  try { return 1; } catch (e) { return 2; }
}
""",
    "app/page.tsx": """'use client';
import fs from 'node:fs';
import { LIMIT } from '../web/store';
export const Page = () => LIMIT;
""",
    "tools/run.py": """from .help import scale


def main(argv):
    for a in argv:
        scale(a)
""",
    "tools/help.py": """def scale(x):
    return x if x else 1
""",
    "jv/shop/Till.java": """package shop;
import shop.parts.Drawer;
public class Till {
  public int open(int n) { return new Drawer().pull(n); }
}
""",
    "jv/shop/parts/Drawer.java": """package shop.parts;
public class Drawer {
  public int pull(int n) { return n; }
}
""",
    "kt/Desk.kt": """package office
import office.tools.*
class Desk {
  fun use() { sharpen() }
}
""",
    "kt/tools/Pen.kt": """package office.tools
fun sharpen() { }
""",
    "cs/Hall.cs": """using House.Rooms;
namespace House
{
  public class Hall { public int Enter() { return 1; } }
}
""",
    "cs/Room.cs": """namespace House.Rooms
{
  public class Room { }
}
""",
    "goapp/main.go": """package main

import "demo.org/mill/grain"

func main() {
\tGrindAll(grain.Seed)
}
""",
    "goapp/grain/grain.go": """package grain

func GrindAll(n int) int { return n }
""",
    "goapp/grain/grain_test.go": """package grain

func TestIt() { }
""",
    "crate/src/lib.rs": """use crate::gear::Wheel;
use super::none::X;
pub fn turn(w: i32) -> i32 { w }
""",
    "crate/src/gear.rs": """pub struct Wheel { pub size: i32 }
""",
    "cc/pump.c": """#include "pump.h"
#include <stdio.h>
int pump(int n) { return n; }
""",
    "cc/pump.h": """int pump(int n);
""",
    "cc/valve.c": """#include "pump.h"
int valve(int n) { return n; }
""",
    "Sources/Core/Base.swift": """public struct Base { }
""",
    "Sources/App/Main.swift": """import Core
import Foundation
public func start() { }
""",
}
MANIFESTS = {"goapp/go.mod": "module demo.org/mill\n\ngo 1.22\n", "crate/Cargo.toml": "[package]\nname = 'crate'\n"}
ALIASES = [("@lib/", "lib/")]


def tree(spark: SparkSession, files: dict[str, str] | None = None) -> Project:
    rows = spark.createDataFrame(sorted((files or FILES).items()), "file string, content string")
    sources = rows.select("file", language_of(F.col("file")).alias("language"), "content")
    marks = spark.createDataFrame(sorted(MANIFESTS.items()), "file string, content string")
    return Project(spark, files=sources, aliases=ALIASES, manifests=marks)


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows; ``columns`` is a list of "name TYPE"."""
    pairs = [c.strip().split(" ", 1) for c in columns.split(",")]

    def literal(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'{n}::{t} AS {n}' for n, t in pairs)} FROM (VALUES {values}) AS t({', '.join(n for n, _ in pairs)})"


_SYMBOLS = [
    ("web/store.ts", "Store", "class", True, 2, 9), ("web/store.ts", "Store.goods", "field", None, 3, 3), ("web/store.ts", "Store.add", "method", None, 4, 8), ("web/store.ts", "LIMIT", "const", True, 10, 10), ("web/store.ts", "unused", "function", True, 11, 11),
    ("web/cart.ts", "fill", "function", True, 4, 7), ("lib/tax.ts", "rate", "function", True, 1, 3), ("app/api/goods/route.ts", "GET", "function", True, 2, 4), ("app/api/goods/route.ts", "POST", "function", True, 5, 7), ("app/page.tsx", "Page", "function", True, 4, 4),
    ("tools/run.py", "main", "function", True, 4, 6), ("tools/help.py", "scale", "function", True, 1, 2),
    ("jv/shop/Till.java", "Till", "class", True, 3, 5), ("jv/shop/Till.java", "Till.open", "method", True, 4, 4), ("jv/shop/parts/Drawer.java", "Drawer", "class", True, 2, 4), ("jv/shop/parts/Drawer.java", "Drawer.pull", "method", True, 3, 3),
    ("goapp/main.go", "main", "function", False, 5, 7), ("goapp/grain/grain.go", "GrindAll", "function", True, 3, 3), ("goapp/grain/grain_test.go", "TestIt", "function", True, 3, 3),
    ("crate/src/lib.rs", "turn", "function", True, 3, 3), ("crate/src/gear.rs", "Wheel", "struct", True, 1, 1), ("crate/src/gear.rs", "Wheel.size", "field", None, 1, 1),
]
_SHOWN = sorted({r[0] for r in _SYMBOLS})


@query(rows_sql("file VARCHAR, qualified_name VARCHAR, kind VARCHAR, exported BOOLEAN, start_line INTEGER, end_line INTEGER", _SYMBOLS))
def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of scripts, Python, Java, Go and Rust."""
    return tree(spark).symbols.where(F.col("file").isin(_SHOWN)).select("file", "qualified_name", "kind", "exported", "start_line", "end_line")


@query(
    rows_sql(
        "file VARCHAR, symbol VARCHAR, from_spec VARCHAR, alias VARCHAR, is_namespace BOOLEAN, is_default BOOLEAN, target VARCHAR, origin VARCHAR",
        [
            ("web/cart.ts", "Store", "./store", None, False, False, "web/store.ts", "relative"), ("web/cart.ts", "LIMIT", "./store", None, False, False, "web/store.ts", "relative"), ("web/cart.ts", "*", "@lib/tax", "tax", True, False, "lib/tax.ts", "alias"),
            ("web/cart.ts", "default", "react", "React", False, True, None, "external"), ("app/api/goods/route.ts", "fill", "../../../web/cart", None, False, False, "web/cart.ts", "relative"), ("app/page.tsx", "default", "node:fs", "fs", False, True, None, "external"),
            ("app/page.tsx", "LIMIT", "../web/store", None, False, False, "web/store.ts", "relative"), ("tools/run.py", "scale", "./help", None, False, False, "tools/help.py", "relative"),
        ],
    )
)
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports by path, alias and name, and the files they reach."""
    return tree(spark).resolved.where(F.col("file").rlike("[.](tsx?|py)$")).select("file", "symbol", "from_spec", "alias", "is_namespace", "is_default", "target", "origin")


_CROSS = [
    ("Sources/App/Main.swift", "Sources/Core/Base.swift"), ("cc/pump.c", "cc/pump.h"), ("cc/valve.c", "cc/pump.h"), ("cc/valve.c", "cc/pump.c"), ("crate/src/lib.rs", "crate/src/gear.rs::Wheel"), ("cs/Hall.cs", "cs/Room.cs"),
    ("goapp/main.go", "goapp/grain/grain.go"), ("jv/shop/Till.java", "jv/shop/parts/Drawer.java::Drawer"), ("kt/Desk.kt", "kt/tools/Pen.kt"),
]


@query(rows_sql("src VARCHAR, dst VARCHAR", _CROSS))
def cross_language_edges(spark: SparkSession, d: str) -> DataFrame:
    """Packages, namespaces, modules, crates and headers."""
    from quarrystone.operators import crosslang

    p = tree(spark)
    return crosslang.edges(p.cross_targets, p.symbols)


_PATH_EDGES = [
    ("app/api/goods/route.ts", "web/cart.ts::fill"), ("app/page.tsx", "web/store.ts::LIMIT"), ("tools/run.py", "tools/help.py::scale"), ("web/cart.ts", "lib/tax.ts"), ("web/cart.ts", "web/store.ts::LIMIT"), ("web/cart.ts", "web/store.ts::Store"),
]


@query(rows_sql("src VARCHAR, dst VARCHAR", _PATH_EDGES + _CROSS))
def project_edges(spark: SparkSession, d: str) -> DataFrame:
    """All import edges of the tree."""
    return tree(spark).edges


@query(
    rows_sql(
        "file VARCHAR, name VARCHAR, n_callers BIGINT, callers VARCHAR",
        [
            ("goapp/grain/grain.go", "GrindAll", 1, "goapp/main.go:main"), ("jv/shop/parts/Drawer.java", "Drawer", 1, "jv/shop/Till.java:Till.open"), ("kt/tools/Pen.kt", "sharpen", 1, "kt/Desk.kt:Desk.use"), ("tools/help.py", "scale", 1, "tools/run.py:main"),
            ("web/cart.ts", "fill", 1, "app/api/goods/route.ts:GET"),
        ],
    )
)
def reverse_calls(spark: SparkSession, d: str) -> DataFrame:
    """Who calls each name whose file is known, across languages' packages too."""
    return tree(spark).called_by()


@query(rows_sql("language VARCHAR, n_files BIGINT, n_symbols BIGINT", [("c", 3, 2), ("csharp", 2, 3), ("go", 3, 3), ("java", 2, 4), ("kotlin", 2, 3), ("python", 2, 2), ("rust", 2, 3), ("swift", 2, 2), ("tsx", 1, 1), ("typescript", 4, 9)]))
def language_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark).languages()


@query(rows_sql("symbol_id VARCHAR, kind VARCHAR, n_lines INTEGER, is_async BOOLEAN, callers VARCHAR, depends_on VARCHAR, n_children BIGINT, complexity BIGINT, rating VARCHAR", [("web/cart.ts::fill", "function", 4, True, "app/api/goods/route.ts", "add,rate", 0, 1, "low")]))
def explain_symbol(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark).explain("fill").select("symbol_id", "kind", "n_lines", "is_async", "callers", "depends_on", "n_children", "complexity", "rating")


_FILL = "export async function fill(store: Store, spare: number) {\n  store.add('pear', LIMIT);\n  return tax.rate(2);\n}"


@query(
    rows_sql(
        "part VARCHAR, item VARCHAR, text VARCHAR, tokens INTEGER",
        [
            ("source", "web/cart.ts::fill", _FILL, round(len(_FILL) / 4)), ("dependency", "web/store.ts::Store", "class Store", 3), ("dependency", "web/store.ts::LIMIT", "const LIMIT = 9", 4), ("dependency", "web/store.ts::unused", "function unused()", 4),
            ("dependency", "lib/tax.ts::rate", "function rate(n: number): number", 8), ("dependent", "app/api/goods/route.ts", "app/api/goods/route.ts", 6),
        ],
    )
)
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark).pack("web/cart.ts::fill")


@query(rows_sql("rule VARCHAR, file VARCHAR, what VARCHAR", [("server-import", "app/page.tsx", "node:fs"), ("unguarded-route", "app/api/goods/route.ts", "app/api/goods/route.ts::GET")]))
def client_and_route_rules(spark: SparkSession, d: str) -> DataFrame:
    """Server imports in client files, and route handlers without a try block."""
    p = tree(spark)
    a = context.server_in_client(p.sources, p.relations.imports).select(F.lit("server-import").alias("rule"), "file", F.col("from_spec").alias("what"))
    return a.unionByName(context.unguarded_routes(p.symbols, p.sources).select(F.lit("unguarded-route").alias("rule"), "file", F.col("symbol_id").alias("what")))


@query(rows_sql("symbol_id VARCHAR, complexity BIGINT", [("web/store.ts::Store.add", 3), ("web/cart.ts::fill", 1), ("lib/tax.ts::rate", 2), ("web/store.ts::unused", 1), ("app/api/goods/route.ts::GET", 1), ("app/api/goods/route.ts::POST", 2), ("tools/run.py::main", 2), ("tools/help.py::scale", 2)]))
def parsed_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Decision points read from the sources: an if with &&, a conditional, a loop, a catch."""
    return tree(spark).complexity().where(F.col("file").rlike("^(web|lib|tools|app/api)/")).select("symbol_id", F.col("complexity").cast("long").alias("complexity"))


@query(rows_sql("file VARCHAR, fn VARCHAR, name VARCHAR", [("web/cart.ts", "fill", "spare")]))
def parsed_unused_params(spark: SparkSession, d: str) -> DataFrame:
    return tree(spark).unused_params()


_NEXT = FILES | {"web/store.ts": FILES["web/store.ts"].replace("count: number)", "count: number, note: string)").replace("export function unused() { return 1; }\n", "export const run = eval('1');\n")}


@query(
    rows_sql(
        "part VARCHAR, file VARCHAR, what VARCHAR",
        [("modified", "web/store.ts", "Store.add"), ("removed", "web/store.ts", "unused"), ("added", "web/store.ts", "run"), ("finding", "web/store.ts", "eval 11")],
    )
)
def pr_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The tree against a changed one: symbols that differ and findings in changed files."""
    old, new = tree(spark), tree(spark, _NEXT)
    changed = new.sources.join(old.sources.select("file", F.col("content").alias("was")), "file").where("content <> was").select("file")
    return context.pr_analysis(old.symbols, new.symbols, new.security(), changed)


@query(rows_sql("cycle VARCHAR, length INTEGER", [("core > ui > core", 2)]))
def package_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles among workspace packages; an outside dependency is none."""
    rows = [("core", "packages/core", "ui", True), ("ui", "packages/ui", "core", True), ("ui", "packages/ui", "left", False), ("app", "packages/app", "ui", True)]
    packages = spark.createDataFrame(rows, "name string, dir string, dependency string, internal boolean")
    return graph.all_cycles(manifests.package_edges(packages), 3)


_LCOV = ["TN:", "SF:src/a.ts", "FNF:2", "FNH:1", "BRF:4", "BRH:1", "LF:10", "LH:5", "end_of_record", "SF:src/b.ts", "LF:4", "LH:4", "end_of_record"]
_SUMMARY = '{"total": {"lines": {"total": 14, "pct": 50}}, "src/a.ts": {"lines": {"total": 10, "pct": 80}, "branches": {"total": 4, "pct": 75}, "functions": {"total": 0, "pct": 0}}}'
_XML = '<coverage><packages><package><classes><class filename="src/c.py" line-rate="0.5" branch-rate="0.25"></class></classes></package></packages></coverage>'


@query(
    rows_sql(
        "report VARCHAR, file VARCHAR, line_cov DOUBLE, branch_cov DOUBLE, function_cov DOUBLE",
        [("lcov", "src/a.ts", 0.5, 0.25, 0.5), ("lcov", "src/b.ts", 1.0, None, None), ("json", "src/a.ts", 0.8, 0.75, None), ("xml", "src/c.py", 0.5, 0.25, None)],
    )
)
def coverage_readers(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of coverage reports, written to the shared folder and read back."""
    out = None
    for kind, lines in (("lcov", _LCOV), ("json", [_SUMMARY]), ("xml", [_XML])):
        path = scratch_path(spark, f"report-{kind}")
        spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, x string").coalesce(1).sortWithinPartitions("n").select("x").write.text(path)
        part = manifests.coverage_report(spark, path, kind).select(F.lit(kind).alias("report"), "file", "line_cov", "branch_cov", "function_cov")
        out = part if out is None else out.unionByName(part)
    return out


@query(rows_sql("plugin VARCHAR, file VARCHAR, rule VARCHAR, message VARCHAR, failed BOOLEAN", [("broken", None, None, None, True), ("long-names", "goapp/grain/grain.go", "long-name", "GrindAll", False)]))
def plugin_findings(spark: SparkSession, d: str) -> DataFrame:
    """A plugin that finds something, and one that fails and stops no other."""
    plugins = {"long-names": lambda s: s.where("length(name) > 7").select("file", F.lit("long-name").alias("rule"), F.col("name").alias("message")), "broken": lambda s: s.select("no_such_column")}
    return context.run_plugins(plugins, tree(spark).symbols).select("plugin", "file", "rule", "message", F.col("error").isNotNull().alias("failed"))


@query(rows_sql("line VARCHAR", [("::error file=web/store.ts,line=11::eval",)]))
def ci_annotations(spark: SparkSession, d: str) -> DataFrame:
    return render.annotations(tree(spark, _NEXT).security())


@query(rows_sql("symbol_id VARCHAR, role VARCHAR, type_name VARCHAR", [("web/cart.ts::fill", "param", "Store")]))
def parsed_type_uses(spark: SparkSession, d: str) -> DataFrame:
    """Where the class of the tree is named as a type."""
    refs = tree(spark).relations.type_refs.where("type_name = 'Store'")
    return refs.select(F.concat_ws("::", "file", "symbol").alias("symbol_id"), "role", "type_name")


@query(rows_sql("file VARCHAR, symbol_id VARCHAR, confidence VARCHAR", [("app/page.tsx", "app/page.tsx::Page", "high"), ("web/store.ts", "web/store.ts::unused", "high"), ("lib/tax.ts", "lib/tax.ts::rate", "high"), ("app/api/goods/route.ts", "app/api/goods/route.ts::GET", "high"), ("app/api/goods/route.ts", "app/api/goods/route.ts::POST", "high")]))
def parsed_dead_exports(spark: SparkSession, d: str) -> DataFrame:
    """Exports of scripts that no import names."""
    return tree(spark).dead_exports().where(F.col("file").rlike("[.]tsx?$")).select("file", "symbol_id", "confidence")


@query(rows_sql("file VARCHAR, text VARCHAR, line INTEGER", [("App.vue", "export function setup() { }", 5)]))
def lifted_scripts(spark: SparkSession, d: str) -> DataFrame:
    """A component's script keeps its lines when all else is blanked."""
    vue = "<template>\n<p>class Fake {}</p>\n</template>\n<script>\nexport function setup() { }\n</script>\n"
    p = tree(spark, {"App.vue": vue})
    s = p.symbols.select("file", F.col("start_line").alias("line"))
    return s.join(p.sources, "file").select("file", F.element_at(F.split("content", "\n"), F.col("line")).alias("text"), "line")
