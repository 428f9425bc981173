"""Diagrams, API documents, reports, annotations and test stubs.

Each cuts its input with an explicit limit first, so what reaches the driver is as large as
the page it makes; ``write_json`` writes tables of any size where they are.
"""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def _node(name: str) -> str:
    return "n_" + "".join(c if c.isalnum() else "_" for c in name)


def module_diagram(module_edges: DataFrame, limit: int = 20) -> str:
    """A Mermaid graph of the heaviest edges between modules."""
    rows = module_edges.orderBy(F.desc("weight"), "src_module", "dst_module").limit(limit).collect()
    out = ["graph LR"] + [f'  {_node(m)}["{m}"]' for m in sorted({x for r in rows for x in (r["src_module"], r["dst_module"])})]
    return "\n".join(out + [f"  {_node(r['src_module'])} -->|{r['weight']}| {_node(r['dst_module'])}" for r in rows])


def dependency_diagram(file_edges: DataFrame, limit: int = 50) -> str:
    """A Mermaid graph of file dependencies, those of the most imported files first."""
    heavy = file_edges.groupBy("dst").agg(F.count(F.lit(1)).alias("__n"))
    rows = file_edges.join(heavy, "dst").orderBy(F.desc("__n"), "dst", "src").limit(limit).collect()
    out = ["graph TD"] + [f'  {_node(f)}["{f}"]' for f in sorted({x for r in rows for x in (r["src"], r["dst"])})]
    return "\n".join(out + [f"  {_node(r['src'])} --> {_node(r['dst'])}" for r in rows])


def class_diagram(symbols: DataFrame, limit: int = 40) -> str:
    """A Mermaid class diagram with members."""
    classes = symbols.where(F.col("kind").isin("class", "interface", "struct")).orderBy("file", "start_line", "symbol_id").limit(limit)
    members = symbols.select(F.col("parent_id").alias("__p"), F.struct("ordinal", "name", "kind", "visibility").alias("m"))
    rows = classes.join(members, F.col("symbol_id") == F.col("__p"), "left").groupBy("symbol_id", "file", "start_line", "name", "kind").agg(F.sort_array(F.collect_list("m")).alias("ms")).orderBy("file", "start_line", "symbol_id").collect()
    out = ["classDiagram"]
    for r in rows:
        out.append(f"  class {_node(r['name'])} {{")
        if r["kind"] == "interface":
            out.append("    <<interface>>")
        out += [f"    {'+' if m['visibility'] == 'public' else '-'}{m['name']}{'()' if m['kind'] in ('method', 'function') else ''}" for m in r["ms"]]
        out.append("  }")
    return "\n".join(out)


def api_docs(symbols: DataFrame) -> DataFrame:
    """(file, markdown): the exported symbols of every file in order, with their signatures and notes."""
    entry = F.concat(F.repeat(F.lit("#"), F.col("depth") + 3), F.lit(" "), "qualified_name", F.lit(" ("), "kind", F.lit(")"), F.coalesce(F.concat(F.lit("\n\n`"), "signature", F.lit("`")), F.lit("")), F.coalesce(F.concat(F.lit("\n\n"), "doc"), F.lit("")))
    shown = symbols.where((F.coalesce("exported", F.lit(True))) & (F.col("visibility") == "public"))
    listed = shown.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", entry.alias("e")))).alias("es"))
    return listed.select("file", F.concat(F.lit("## "), "file", F.lit("\n\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n\n")).alias("markdown"))


def annotations(findings: DataFrame) -> DataFrame:
    """Lines that a CI log shows at the source line."""
    level = F.when(F.col("severity").isin("critical", "high", "error"), "error").otherwise("warning")
    return findings.select(F.format_string("::%s file=%s,line=%s::%s", level, "file", F.coalesce(F.col("line_no").cast("string"), F.lit("1")), "rule").alias("line"))


_STUBS = {
    "jest": ("describe('{file}', () => {{", "  test('{name}', () => {{\n    expect({name}).toBeDefined();\n  }});", "}});"),
    "vitest": ("import {{ describe, expect, it }} from 'vitest';\ndescribe('{file}', () => {{", "  it('{name}', () => {{\n    expect({name}).toBeDefined();\n  }});", "}});"),
    "mocha": ("const assert = require('assert');\ndescribe('{file}', () => {{", "  it('{name}', () => {{\n    assert.ok({name});\n  }});", "}});"),
    "pytest": ("# tests of {file}", "def test_{name}():\n    assert {name} is not None\n", ""),
    "junit": ("class {stem}Test {{", "  @Test void {name}() {{\n    fail(\"not written\");\n  }}", "}}"),
    "go": ("package {stem}_test", "func Test{title}(t *testing.T) {{\n\tt.Skip(\"not written\")\n}}", ""),
}


def test_stubs(symbols: DataFrame, framework: str) -> DataFrame:
    """(file, stub): a test skeleton for the exported functions and classes of every file."""
    head, each, tail = _STUBS[framework]
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "[.].*$", "")

    def fill(template: str, **fields):
        out = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
        for k, v in fields.items():
            out = F.replace(out, F.lit("{" + k + "}"), v)
        return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))

    shown = symbols.where(F.col("exported") & F.col("kind").isin("function", "class"))
    case = fill(each, name=F.col("name"), title=F.initcap("name"))
    parts = shown.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", case.alias("c")))), lambda x: x["c"]), "\n").alias("cases"))
    return parts.select("file", F.concat_ws("\n", fill(head, file=F.col("file"), stem=stem), "cases", fill(tail)).alias("stub"))


def html_table(title: str, df: DataFrame, limit: int = 25) -> str:
    rows = df.limit(limit).collect()
    esc = lambda x: html.escape("" if x is None else str(x))
    head = "".join(f"<th>{esc(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<section><h2>{esc(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


def html_report(title: str, tables: dict[str, DataFrame], limit: int = 25) -> str:
    """One page with the first rows of each table; order the tables before."""
    style = "body{font-family:sans-serif;margin:2rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem;text-align:left}"
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><meta charset=utf-8><style>{style}</style><body><h1>{html.escape(title)}</h1>{''.join(html_table(k, v, limit) for k, v in tables.items())}</body>"


def skeleton_tree(symbols: DataFrame, files: list[str]) -> dict[str, list[dict]]:
    """The nested symbols of a few files, as they would be serialised."""
    rows = [r.asDict() for r in symbols.where(F.col("file").isin(files)).orderBy("file", "ordinal").collect()]
    by_id: dict[str, dict] = {}
    out: dict[str, list[dict]] = {f: [] for f in files}
    for r in rows:
        node = {k: v for k, v in r.items() if v not in (None, []) and k not in ("parent_id", "depth", "ordinal", "file")} | {"children": []}
        parent = by_id.get(r["parent_id"])
        (parent["children"] if parent else out[r["file"]]).append(node)
        by_id[r["symbol_id"]] = node
    return out


def skeleton_page(symbols: DataFrame, files: list[str]) -> str:
    """One page with the nested symbols of a few files, folded at each symbol that has others below it."""
    esc = html.escape

    def item(node: dict) -> str:
        lines = f"{node['start_line']}-{node['end_line']}"
        head = f"<b>{esc(node['name'])}</b> <i>{esc(node['kind'])}</i> <small>{lines}</small> <code>{esc(node.get('signature', ''))}</code>"
        below = "".join(map(item, node["children"]))
        return f"<li><details open><summary>{head}</summary><ul>{below}</ul></details></li>" if below else f"<li>{head}</li>"

    parts = "".join(f"<section><h2>{esc(f)}</h2><ul>{''.join(map(item, nodes))}</ul></section>" for f, nodes in skeleton_tree(symbols, files).items())
    return f"<!DOCTYPE html><title>Symbols</title><meta charset=utf-8><body>{parts}</body>"


def graph_page(file_edges: DataFrame, coupled: DataFrame, limit: int = 500) -> str:
    """One page that draws the ``limit`` most coupled files on a circle, their imports as lines; pointing at one shows its figures."""
    files = coupled.orderBy(F.desc(F.col("ca") + F.col("ce")), "file").limit(limit)
    nodes = [r.asDict() for r in files.select("file", "ca", "ce", "instability").collect()]
    place = {r["file"]: k for k, r in enumerate(nodes)}
    own = files.select("file")
    inner = file_edges.join(own.withColumnRenamed("file", "src"), "src", "left_semi").join(own.withColumnRenamed("file", "dst"), "dst", "left_semi")
    links = sorted((place[r["src"]], place[r["dst"]]) for r in inner.select("src", "dst").collect())
    at = [(400 + 360 * math.cos(2 * math.pi * k / max(1, len(nodes))), 400 + 360 * math.sin(2 * math.pi * k / max(1, len(nodes)))) for k in range(len(nodes))]
    lines = "".join(f'<line x1="{at[a][0]:.0f}" y1="{at[a][1]:.0f}" x2="{at[b][0]:.0f}" y2="{at[b][1]:.0f}" stroke="#999"/>' for a, b in links)
    dots = "".join(f'<circle cx="{x:.0f}" cy="{y:.0f}" r="5"><title>{html.escape(n["file"])}: in {n["ca"]}, out {n["ce"]}, instability {n["instability"]}</title></circle>' for n, (x, y) in zip(nodes, at, strict=True))
    return f'<!DOCTYPE html><title>Imports</title><meta charset=utf-8><svg viewBox="0 0 800 800" xmlns="http://www.w3.org/2000/svg">{lines}{dots}</svg>'
