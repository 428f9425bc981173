import json
import subprocess

import pytest

from quarrystone.operators import context
from quarrystone.project import Project
from quarrystone.sinks import render
from quarrystone.sources import manifests, revisions, scan
from quarrystone.sources.parse import lift_scripts, parse_file

FILES = {
    "utils.ts": "// Hash it\nexport function hashPassword(p: string): string {\n  return p;\n}\n\nexport function formatDate(d: Date) { return d; }\n\nexport function neverUsed() { return 1; }\nexport const MAX_RETRIES = 3;\n",
    "auth.ts": "import { hashPassword, MAX_RETRIES } from './utils';\nexport interface Session {\n  id: string;\n}\n/** Authenticate a user. */\nexport async function login(user: string, unused: number) {\n  if (user && MAX_RETRIES > 1) { return hashPassword(user); }\n  return user ? 1 : 2;\n}\nexport const logout = () => { formatAll(); };\n",
    "router.ts": "import { login, logout } from './auth.js';\nimport type { Session } from './auth';\nexport class Router {\n  private size: number = 0;\n  handle(req: Session): void {\n    login(req);\n  }\n}\nconst lazy = () => import('./cycle-a');\n",
    "cycle-a.ts": "import { b } from './cycle-b';\nexport function a() { b(); }\n",
    "cycle-b.ts": "import * as c from './cycle-a';\nexport function b() { c.a(); }\n",
    "pkg/__init__.py": "",
    "pkg/core.py": 'from .util import helper\nfrom . import other\nimport os\n\n\nclass Thing:\n    """A thing."""\n\n    size: int = 0\n\n    @property\n    def name(self) -> str:\n        return helper(self.size) if self.size and os else ""\n\n\ndef _hidden(x, y):\n    for k in x:\n        pass\n',
    "pkg/util.py": "def helper(n: int):\n    return n\n",
    "pkg/other.py": "X = 1\n",
    "main.go": "package main\n\nimport \"fmt\"\n\ntype Server struct {\n\tName string\n}\n\nfunc (s *Server) Run(n int) error {\n\tif n > 0 && s != nil {\n\t\treturn nil\n\t}\n\treturn nil\n}\n\nfunc private() {}\n",
    "lib.rs": "use crate::a::{b, c as d};\npub struct P { x: i32 }\npub fn run(a: i32) -> i32 { if a > 0 { 1 } else { 2 } }\nfn hidden() {}\n",
    "A.java": "package x;\nimport java.util.List;\npublic class A {\n  private int n;\n  public int size(String s) { return n; }\n}\n",
    "t.rb": "require_relative 'u'\nclass T\n  def open\n    if x\n      1\n    end\n  end\n  private\n  def shut\n  end\nend\n",
    "App.vue": "<template>\n<p>class Fake {}</p>\n</template>\n<script>\nimport { a } from './cycle-a';\nexport function setup() { a(); }\n</script>\n",
    "bad.py": "def broken(:\n",
    "node_modules/x.ts": "export const skipped = 1;\n",
    "notes.txt": "nothing\n",
    "test/auth.test.ts": "import { login } from '../auth';\nlogin('x');\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def project(spark, tree):
    return Project(spark, str(tree))


def test_scan(spark, tree, project):
    names = {r["file"] for r in project.sources.collect()}
    assert names == set(FILES) - {"node_modules/x.ts", "notes.txt"}
    with pytest.raises(PermissionError):
        scan.source_files(spark, "/etc", roots=[str(tree)])


def test_symbols(project):
    s = {r["symbol_id"]: r for r in project.symbols.collect()}
    assert s["utils.ts::hashPassword"]["exported"] and s["utils.ts::hashPassword"]["doc"] == "Hash it"
    assert (s["utils.ts::hashPassword"]["start_line"], s["utils.ts::hashPassword"]["end_line"]) == (2, 4)
    assert s["auth.ts::login"]["signature"].startswith("export async function login(user: string") or "async function login(user: string" in s["auth.ts::login"]["signature"]
    assert s["auth.ts::logout"]["kind"] == "function" and s["auth.ts::Session"]["kind"] == "interface"
    assert s["router.ts::Router.handle"]["kind"] == "method" and s["router.ts::Router.size"]["visibility"] == "private"
    assert "router.ts::lazy" not in {k for k, v in s.items() if v["exported"]}
    assert s["pkg/core.py::Thing.name"]["decorators"] == ["property"] and s["pkg/core.py::_hidden"]["exported"] is False
    assert s["pkg/core.py::Thing"]["doc"] == "A thing."
    assert s["main.go::Server"]["kind"] == "struct" and s["main.go::Run"]["exported"] and not s["main.go::private"]["exported"]
    assert s["lib.rs::run"]["exported"] and not s["lib.rs::hidden"]["exported"]
    assert s["A.java::A.size"]["kind"] == "method" and s["A.java::A.n"]["visibility"] == "private"
    assert s["t.rb::T.shut"]["visibility"] == "private" and s["t.rb::T.open"]["visibility"] == "public"
    assert "App.vue::setup" in s and s["App.vue::setup"]["start_line"] == 6 and not any("Fake" in k for k in s)
    errors = {r["file"] for r in project.files.where("error is not null").collect()}
    assert errors == {"bad.py"}


def test_edges_and_dead_code(project):
    e = {tuple(r) for r in project.edges.collect()}
    assert {("auth.ts", "utils.ts::hashPassword"), ("router.ts", "auth.ts::login"), ("router.ts", "auth.ts::Session"), ("cycle-b.ts", "cycle-a.ts"), ("router.ts", "cycle-a.ts"), ("pkg/core.py", "pkg/util.py::helper"), ("pkg/core.py", "pkg/other.py")} <= e
    dead = {r["symbol_id"] for r in project.dead_exports().collect()}
    assert "utils.ts::neverUsed" in dead and not {"auth.ts::login", "utils.ts::hashPassword"} & dead
    assert [r["cycle"] for r in project.cycles().collect()] == ["cycle-a.ts > cycle-b.ts > cycle-a.ts"]
    origin = {(r["file"], r["from_spec"]): r["origin"] for r in project.resolved.collect()}
    assert origin["pkg/core.py", "os"] == "external" and origin["router.ts", "./auth.js"] == "relative"


def test_impact(project):
    got = {r["file"]: r["distance"] for r in project.impact("login").collect()}
    assert got == {"router.ts": 1, "test/auth.test.ts": 1}
    assert project.impact("neverUsed").count() == 0
    assert {r["file"] for r in project.impact("hashPassword").collect()} == {"auth.ts", "router.ts", "test/auth.test.ts"}
    assert {r["file"] for r in project.impact("hashPassword", compat=True).collect()} == {"auth.ts"}


def test_analyses(project):
    c = {r["symbol_id"]: r["complexity"] for r in project.complexity().collect()}
    assert c["auth.ts::login"] == 4 and c["utils.ts::hashPassword"] == 1 and c["pkg/core.py::Thing.name"] == 3 and c["main.go::Run"] == 3
    assert {(r["fn"], r["name"]) for r in project.unused_params().where("file = 'auth.ts'").collect()} == {("login", "unused")}
    calls = {(r["caller"], r["callee"]): r["origin"] for r in project.call_graph().where("file = 'auth.ts'").collect()}
    assert calls["login", "hashPassword"] == "import" and calls["logout", "formatAll"] == "unknown"
    roles = {(r["symbol"], r["role"]) for r in project.relations.type_refs.where("type_name = 'Session'").collect()}
    assert ("Router.handle", "param") in roles
    assert {r["test"] for r in project.test_map().collect()} == {"test/auth.test.ts"}
    m = project.metrics().first()
    assert m["cycles"] == 1 and 0 <= m["score"] <= 100
    assert project.gate({"max_cycles": 0}).count() == 1
    assert project.find("authenticate user").first()["symbol_id"] == "auth.ts::login"
    assert project.fixes().where("fix = 'remove-export'").count() > 0
    assert project.similar().count() > 0 and project.module_coupling().count() >= 2


def test_context(spark, project):
    r = project.explain("login").first()
    assert r["callers"] == "router.ts,test/auth.test.ts" and r["is_async"] and r["depends_on"] == "hashPassword"
    parts = {x["part"] for x in project.pack("auth.ts::login").collect()}
    assert parts == {"source", "dependency", "dependent"}
    types = {(x["symbol_id"], x["type_id"]) for x in context.related_types(project.symbols).collect()}
    assert ("router.ts::Router.handle", "auth.ts::Session") in types
    good = lambda s, *_: s.select("file", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("r").alias("rule"), s["name"].alias("message")).limit(1)
    rows = context.run_plugins({"good": good, "bad": lambda *_: 1 / 0}, project.symbols).collect()
    assert {(x["plugin"], x["error"] is None) for x in rows} == {("good", True), ("bad", False)}


def test_rendering(spark, project, tmp_path):
    assert "auth.ts" in render.dependency_diagram(project.file_edges)
    assert "class n_Router" in render.class_diagram(project.symbols)
    docs = {r["file"]: r["markdown"] for r in render.api_docs(project.symbols).collect()}
    assert "### login (function)" in docs["auth.ts"]
    for f in render._STUBS:
        stubs = {r["file"]: r["stub"] for r in render.test_stubs(project.symbols, f).collect()}
        assert "login" in stubs["auth.ts"].lower() and "{{" not in stubs["auth.ts"]
    page = render.html_report("R", {"Dead": project.dead_exports()})
    assert "<h2>Dead</h2>" in page
    tree = render.skeleton_tree(project.symbols, ["router.ts"])
    assert [c["name"] for c in tree["router.ts"][0]["children"]] == ["size", "handle"] or {c["name"] for c in tree["router.ts"][0]["children"]} == {"size", "handle"}
    render.write_json(project.coupling(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == project.files.count()
    line = render.annotations(spark.createDataFrame([("a.ts", 3, "eval", "critical")], "file string, line_no int, rule string, severity string")).first()["line"]
    assert line == "::error file=a.ts,line=3::eval"


def test_lift_keeps_lines():
    text = FILES["App.vue"]
    assert lift_scripts(text).count("\n") == text.count("\n") and "Fake" not in lift_scripts(text)


def test_awkward_sources(spark):
    files = spark.createDataFrame([("a.ts", "typescript", None), ("b.ts", "typescript", ""), ("c.ts", "typescript", "}}}((('"), ("d.py", "python", "x = 1\n" * 5000)], "file string, language string, content string")
    p = Project(spark, files=files)
    assert {r["file"] for r in p.files.collect()} == {"b.ts", "c.ts", "d.py"}
    assert Project(spark, files=files.where("false")).symbols.count() == 0
    assert parse_file("x.cpp", "cpp", "int main(int c) { return 0; }\n").symbols[0]["name"] == "main"


def test_manifests(spark, tmp_path):
    for name, deps in (("a", {"@d/b": "1", "lodash": "1"}), ("b", {}), ("c", {"@d/a": "1", "@d/b": "1"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "package.json").write_text(json.dumps({"name": f"@d/{name}", "dependencies": deps}))
    w = manifests.workspace(spark, str(tmp_path))
    assert w.select("name").distinct().count() == 3 and manifests.package_edges(w).count() == 3
    (tmp_path / "base.json").write_text('{"compilerOptions": {"paths": {"@/*": ["src/*"], "~x": ["x.ts"],}, /* here */ "baseUrl": "."}} // note')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base", "compilerOptions": {"paths": {"@/*": ["lib/*"]}}}')
    assert manifests.path_aliases(str(tmp_path / "tsconfig.json")) == [("@/", f"{tmp_path}/lib/"), ("~x", f"{tmp_path}/x.ts")]
    raw = json.dumps({"sources": ["x.ts"], "sourceRoot": "/src/"})
    import base64

    assert manifests.source_map(f"x\n//# sourceMappingURL=data:application/json;base64,{base64.b64encode(raw.encode()).decode()}") == ["/src/x.ts"]
    assert manifests.source_map("none") == []


def test_coverage_reports(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"total": {}, "a.ts": {"lines": {"total": 5, "pct": 80}, "branches": {"total": 4, "pct": 75}, "functions": {"total": 0, "pct": 100}}}))
    (tmp_path / "l.info").write_text("TN:\nSF:a.ts\nFNF:2\nFNH:1\nLF:10\nLH:8\nend_of_record\nSF:b.ts\nLF:0\nLH:0\nend_of_record\n")
    (tmp_path / "c.xml").write_text('<coverage><class filename="a.py" line-rate="0.5" branch-rate="0.25"/></coverage>')
    (tmp_path / "d.xml").write_text('<coverage><file name="a.php" path="src/a.php"><metrics statements="4" coveredstatements="3" conditionals="0" coveredconditionals="0"/></file></coverage>')
    read = lambda n: {r["file"]: (r["line_cov"], r["branch_cov"], r["function_cov"]) for r in manifests.coverage_report(spark, str(tmp_path / n)).collect()}
    assert read("s.json") == {"a.ts": (0.8, 0.75, None)}
    assert read("l.info") == {"a.ts": (0.8, None, 0.5), "b.ts": (None, None, None)}
    assert read("c.xml") == {"a.py": (0.5, 0.25, None)}
    assert read("d.xml") == {"src/a.php": (0.75, None, None)}


def test_revisions(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "a.ts").write_text("export const a = 1\n")
    (tmp_path / "b.ts").write_text("x\n")
    git("add", ".")
    git("commit", "-m", "one")
    (tmp_path / "a.ts").write_text("export const a = 2\n")
    (tmp_path / "b.ts").unlink()
    (tmp_path / "c.ts").write_text("new\n")
    assert {tuple(r) for r in revisions.changed(spark, str(tmp_path)).collect()} == {("a.ts", "M"), ("b.ts", "D"), ("c.ts", "A")}
    assert revisions.contents_at(spark, str(tmp_path), ["a.ts", "zz"]).first()["content"] == "export const a = 1\n"
    assert {tuple(r) for r in revisions.churn(spark, str(tmp_path)).collect()} == {("a.ts", 1), ("b.ts", 1)}
