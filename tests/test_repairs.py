"""Overloads, brackets of any depth, repeated report rows, latest rows, whole notes; and imports of packages, crates and modules."""

from pyspark.sql import functions as F

from quarrystone.operators import crosslang
from quarrystone.operators import delta as D
from quarrystone.operators import graph as G
from quarrystone.operators import quality as Q
from quarrystone.operators import search as S
from quarrystone.plans import source_plans
from quarrystone.project import Project
from quarrystone.sources import scan
from quarrystone.sources.parse import parse_file
from quarrystone.streaming.refresh import VersionedTable, watch


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_overloads_are_paired_once(spark):
    rows = [("f", "go", "(a)"), ("f", "go", "(a, b)"), ("f", "stay", None)]
    old = spark.createDataFrame(rows, "file string, qualified_name string, signature string")
    key = ["file", "qualified_name"]
    assert got(D.symbol_diff(old, old, key)) == []
    new = spark.createDataFrame([*rows[:1], ("f", "go", "(a, c)"), ("f", "go", "(d)"), rows[2]], old.schema)
    assert got(D.symbol_diff(old, new, key)) == [("f", "go", "added", None, "(d)"), ("f", "go", "modified", "(a, b)", "(a, c)")]


def test_brackets_of_any_depth(spark):
    deep = "(" * 12 + "1, 2" + ")" * 12
    rows = [(f"f(a = {deep}, b: Map<K, V[]>, c) => Promise<[x, y]>",), ("f()",), ("no list",), ("g(x: (p, q) => void, y)",)]
    df = spark.createDataFrame(rows, "s string").select(F.size(Q.parameter_list(F.col("s"))).alias("n"))
    assert [r["n"] for r in df.collect()] == [3, 0, None, 2]


def test_the_last_row_of_a_report_counts(spark):
    files = spark.createDataFrame([("a/x.ts",)], "file string")
    report = spark.createDataFrame([(1, "a/x.ts", 0.9, 0.8), (2, "a/x.ts", 0.1, None)], "n int, file string, line_cov double, branch_cov double")
    assert got(Q.merge_coverage(files, report)) == [("a/x.ts", 0.1, None, "path")]


def test_the_latest_row_reaches_the_reader(spark, tmp_path):
    schema = "file string, hash string, content string, modified long"
    spark.createDataFrame([("a", "zz", "old", 1), ("a", "aa", "new", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen, state = [], VersionedTable(spark, f"{tmp_path}/state", "file string, hash string")
    q = watch(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), state, lambda df, n: seen.extend(df.collect()), f"{tmp_path}/check")
    q.awaitTermination()
    assert [(r["file"], r["content"]) for r in seen] == [("a", "new")] and got(state.read()) == [("a", "aa")]


def test_notes_are_kept_whole():
    note = "word " * 300
    s = parse_file("a.ts", "typescript", f"// {note}\nexport function f() {{}}\n").symbols[0]
    assert s["doc"] == note.strip()
    assert parse_file("a.py", "python", f'def f():\n    """{note}"""\n').symbols[0]["doc"].strip() == note.strip()


def test_rules_on_lines_of_a_file(spark):
    text = "\n".join(["const a = 1;", "app.get('/x', h);", "", "", "", "", "limiter()", "", "// eval(x)", "eval (y)", "EVAL(z)"])
    files = spark.createDataFrame([("a.ts", text), ("b.ts", "app.get('/x', h);"), ("c.ts", None), ("d.ts", "")], "file string, content string")
    assert got(S.scan_files(files).select("file", "line_no", "rule")) == [("a.ts", 10, "eval"), ("b.ts", 1, "no-rate-limit")]
    near = [S.LineRule("todo", "low", "TODO")]
    files = spark.createDataFrame([("a.ts", "x\nTODO y")], "file string, content string")
    assert got(S.scan_files(files, near)) == [("a.ts", 2, "todo", "low", "TODO y")]


def test_terms_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["c"])], "id int, t array<string>")
    assert got(S.term_counts(docs, "id", F.col("t"))) == [(1, "a", 1, 4), (1, "b", 3, 4), (3, "c", 1, 1)]


def _targets(spark, files, manifests=()):
    rows = spark.createDataFrame(list(files.items()), "file string, content string")
    marks = spark.createDataFrame(list(manifests), "file string, content string")
    p = Project(spark, files=rows.select("file", source_plans.language_of(F.col("file")).alias("language"), "content"), manifests=marks)
    return got(p.cross_targets.select("file", "target", "whole"))


def test_rust_paths(spark):
    files = {"c/src/lib.rs": "use crate::a::b::T;\nuse crate::a::*;\nuse std::io::Read;\nuse self::d::E;\n", "c/src/a/mod.rs": "use super::d::E;\n", "c/src/a/b.rs": "use crate::none::X;\n", "c/src/d.rs": "pub struct E;\n"}
    cargo = [("c/Cargo.toml", "[package]")]
    found = set(_targets(spark, files, cargo))
    assert ("c/src/lib.rs", "c/src/a/b.rs", False) in found and ("c/src/lib.rs", "c/src/d.rs", False) in found
    assert not any("none" in t or "std" in t for _, t, _ in found)


def test_go_modules_and_java_wildcards(spark):
    files = {"m/x.go": 'package m\nimport (\n  "fmt"\n  "ex.org/m/sub"\n  "ex.org/other"\n)\n', "m/sub/a.go": "package sub\n", "m/sub/b.go": "package sub\n", "m/sub/b_test.go": "package sub\n"}
    assert _targets(spark, files, [("m/go.mod", "module ex.org/m\n")]) == [("m/x.go", "m/sub/a.go", True), ("m/x.go", "m/sub/b.go", True)]
    files = {"A.java": "package p;\nimport q.*;\nimport q.B;\nimport java.util.List;\npublic class A {}\n", "B.java": "package q;\npublic class B {}\n", "C.java": "package q;\nclass C {}\n"}
    assert _targets(spark, files) == [("A.java", "B.java", False), ("A.java", "B.java", True), ("A.java", "C.java", True)]


def test_a_name_that_is_not_exported_falls_back_to_the_file(spark):
    symbols = spark.createDataFrame([("t.java", "T", "t.java::T", True)], "file string, name string, symbol_id string, exported boolean")
    found = spark.createDataFrame([("a", "T", "t.java", False), ("b", "Hidden", "t.java", False), ("c", "*", "t.java", True)], "file string, symbol string, target string, whole boolean")
    assert got(crosslang.edges(found, symbols)) == [("a", "t.java::T"), ("b", "t.java"), ("c", "t.java")]


def test_manifests_are_found_by_name(spark, tmp_path):
    for name in ("go.mod", "sub/Cargo.toml", "node_modules/go.mod", "other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("module x\n")
    found = scan.named_files(spark, str(tmp_path), ("Cargo.toml", "go.mod"))
    assert got(crosslang.roots(found)) == [("cargo", "sub/", None), ("go", "", "x")]


def test_callers_through_whole_imports(spark):
    calls = spark.createDataFrame([("a.cs", "M.run", "go"), ("b.cs", "N.run", "go"), ("a.cs", "M.run", "mine")], "file string, caller string, callee string")
    symbols = spark.createDataFrame([("t.cs", "go", True, "public"), ("a.cs", "mine", True, "public")], "file string, name string, exported boolean, visibility string")
    none = spark.createDataFrame([], "file string, symbol string, alias string, target string")
    whole = spark.createDataFrame([("a.cs", "t.cs")], "src string, dst string")
    g = G.call_graph(calls, none, symbols, whole)
    assert got(g) == [("a.cs", "M.run", "go", "import", "t.cs"), ("a.cs", "M.run", "mine", "local", "a.cs"), ("b.cs", "N.run", "go", "unknown", None)]
    assert got(G.called_by(g)) == [("a.cs", "mine", 1, "a.cs:M.run"), ("t.cs", "go", 1, "a.cs:M.run")]


def test_parameters_are_trimmed_of_spaces(spark):
    rows = [("f(a, this, b)", ["a", "b"]), ("f(a,  , b)", ["a", "b"]), ("f(0a, 1b1, this: T, 2c)", ["0a", "1b1", "2c"]), ("f( this )", [])]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string").select("s", Q.parameter_list(F.col("s")).alias("p"))
    assert {r["s"]: r["p"] for r in df.collect()} == dict(rows)
