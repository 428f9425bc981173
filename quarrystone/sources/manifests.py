"""Workspace manifests, path aliases, source maps and coverage reports as DataFrames.

Manifests and configurations are small and read on the driver; reports are read by Spark.
"""

from __future__ import annotations

import base64
import json
import re
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Workspaces


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """(name, dir, dependency, internal): one row for each dependency of each package under ``root``."""
    base, found = Path(root), {}
    for p in sorted(base.rglob("package.json")):
        if "node_modules" in p.parts:
            continue
        try:
            data = json.loads(p.read_text(encoding="utf-8"))
        except ValueError:
            continue
        if data.get("name"):
            deps = {d for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for d in data.get(k) or {}}
            found[data["name"]] = (str(p.parent.relative_to(base)), sorted(deps))
    rows = [(n, d, x, x in found) for n, (d, deps) in found.items() for x in deps or [None]]
    return spark.createDataFrame(rows, "name string, dir string, dependency string, internal boolean")


def package_edges(packages: DataFrame) -> DataFrame:
    return packages.where("internal").select(F.col("name").alias("src"), F.col("dependency").alias("dst")).distinct()


# Aliases


def read_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))


def path_aliases(config: str, depth: int = 5) -> list[tuple[str, str]]:
    """(prefix, replacement) of a configuration's path patterns; those of what it extends come after its own."""
    p = Path(config)
    if depth <= 0 or not p.exists():
        return []
    data = read_jsonc(p.read_text(encoding="utf-8"))
    options = data.get("compilerOptions") or {}
    base = (p.parent / options.get("baseUrl", ".")).resolve()
    own = [(k.rstrip("*"), str(base / v[0].rstrip("*")).rstrip("/") + ("/" if k.endswith("*") else "")) for k, v in (options.get("paths") or {}).items() if v]
    parent = data.get("extends")
    rest = path_aliases(str((p.parent / parent).with_suffix(".json")), depth - 1) if isinstance(parent, str) and parent.startswith(".") else []
    known = {k for k, _ in own}
    return own + [(k, v) for k, v in rest if k not in known]


# Source maps


def source_map(text: str, folder: str = ".") -> list[str]:
    """The sources that a file's last source-map comment names, under its sourceRoot."""
    hits = re.findall(r"[#@]\s*sourceMappingURL=(\S+)", text)
    if not hits:
        return []
    url = hits[-1]
    if url.startswith("data:"):
        head, _, body = url.partition(",")
        raw = base64.b64decode(body).decode("utf-8") if head.endswith("base64") else unquote(body)
    else:
        p = Path(folder) / url
        if not p.exists():
            return []
        raw = p.read_text(encoding="utf-8")
    data = json.loads(raw)
    root = data.get("sourceRoot") or ""
    return [f"{root.rstrip('/')}/{s}" if root else s for s in data.get("sources", [])]


# Coverage reports

_COLUMNS = "file string, line_cov double, branch_cov double, function_cov double"


def coverage_report(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, line_cov, branch_cov, function_cov) of a summary (JSON), lcov or clover/cobertura (XML) report."""
    kind = kind or ("xml" if path.endswith(".xml") else "json" if path.endswith(".json") else "lcov")
    if kind == "json":
        text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        share = lambda x: None if not x or not x.get("total") else x["pct"] / 100
        rows = [(f, share(v.get("lines")), share(v.get("branches")), share(v.get("functions"))) for f, v in json.loads(text).items() if f != "total"]
        return spark.createDataFrame(rows, _COLUMNS)
    if kind == "xml":
        text = F.col("value")
        node = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(text, F.lit(r"<(?:class|file)\b[^>]*>"), 0)).alias("tag"), text.alias("all"))
        at = lambda name: F.regexp_extract("tag", rf'\b{name}="([^"]*)"', 1)
        cobertura = node.where(at("filename") != "").groupBy(at("filename").alias("file")).agg(F.avg(at("line-rate").try_cast("double")).alias("line_cov"), F.avg(at("branch-rate").try_cast("double")).alias("branch_cov"))
        body = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<file\b[^>]*\b(?:path|name)=.*?</file>"), 0)).alias("tag"))
        m = F.regexp_extract("tag", r"(<metrics\b[^>]*>)", 1)
        num = lambda name: F.regexp_extract(m, rf'\b{name}="(\d+)"', 1).try_cast("double")
        ratio = lambda a, b: F.when(num(b) > 0, num(a) / num(b))
        clover = body.select(F.coalesce(F.nullif(at("path"), F.lit("")), at("name")).alias("file"), ratio("coveredstatements", "statements").alias("line_cov"), ratio("coveredconditionals", "conditionals").alias("branch_cov"))
        return cobertura.unionByName(clover).select("file", "line_cov", "branch_cov", F.lit(None).cast("double").alias("function_cov"))
    # A record runs from its SF line to end_of_record; a running count numbers them. Reports are one small file.
    lines = spark.read.text(path).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    record = F.count_if(F.col("value").startswith("SF:")).over(Window.partitionBy().orderBy("n"))
    tag, value = F.regexp_extract("value", "^([A-Z]+):", 1), F.regexp_extract("value", "^[A-Z]+:(.*)$", 1)
    rows = lines.select(record.alias("r"), tag.alias("tag"), value.alias("v")).where("r > 0")
    pick = lambda t: F.max(F.when(F.col("tag") == t, F.col("v")))
    ratio = lambda hit, all_: F.when(pick(all_).cast("double") > 0, pick(hit).cast("double") / pick(all_).cast("double"))
    return rows.groupBy("r").agg(pick("SF").alias("file"), ratio("LH", "LF").alias("line_cov"), ratio("BRH", "BRF").alias("branch_cov"), ratio("FNH", "FNF").alias("function_cov")).drop("r")
