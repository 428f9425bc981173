import itertools

import pytest

from quarrystone.operators import delta as D
from quarrystone.operators import graph as G


@pytest.fixture
def df(spark):
    return lambda rows, schema: spark.createDataFrame(list(rows), schema)


@pytest.fixture
def e(df):
    return lambda *pairs: df(pairs, "src string, dst string")


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_layer_violation_of_one_edge(df, e):
    edges = e(("x1", "s"), ("x2", "s"), ("x3", "s"), ("s", "v"), ("v", "y1"), ("v", "y2"))
    files = df([(f,) for f in ("x1", "x2", "x3", "s", "v", "y1", "y2", "alone")], "file string")
    c = G.coupling(files, edges)
    rows = {r["file"]: r for r in c.collect()}
    assert (rows["s"]["ca"], rows["s"]["ce"], rows["s"]["instability"]) == (3, 1, 0.25)
    assert rows["alone"]["instability"] == 0.0
    assert sum(r["ca"] for r in rows.values()) == sum(r["ce"] for r in rows.values()) == 6
    assert got(G.layer_violations(edges, c).select("src", "dst", "severity")) == [("s", "v", 0.42)]


def test_modules(df, e):
    m = df([("ui/a", "ui"), ("api/b", "api"), ("core/c", "core"), ("core/d", "core")], "file string, module string")
    edges = e(("ui/a", "api/b"), ("api/b", "core/c"), ("core/c", "core/d"))
    rows = {r["module"]: r for r in G.module_coupling(edges, m).collect()}
    assert [rows[x]["instability"] for x in ("ui", "api", "core")] == [1.0, 0.5, 0.0]
    assert G.module_edges(edges, m).count() == 2 and rows["core"]["n_files"] == 2


def test_cycles_against_enumeration(e):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("d", "c")]
    nodes, has, want = sorted({x for p in edges for x in p}), set(edges), set()
    for n in (2, 3, 4):
        for p in itertools.permutations(nodes, n):
            if p[0] == min(p) and all((p[k], p[(k + 1) % n]) in has for k in range(n)):
                want.add((" > ".join((*p, p[0])), n))
    assert set(got(G.elementary_cycles(e(*edges), 4))) == want and want
    assert got(G.cyclic_core(e(("a", "b"), ("b", "c")))) == []


def test_impact_is_the_reverse_closure(df, e):
    edges = e(("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("z", "y"))
    seeds = df([("a", "a"), ("y", "y"), ("q", "q")], "seed string, file string")
    rows = got(G.impact(edges, seeds))
    assert rows == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("y", "z", 1)]


def test_dead_duplicates_and_orphans(df, e):
    s = df([("u::f", "u", "f", "function", True), ("u::g", "u", "g", "function", True), ("u::T", "u", "T", "type", True), ("v::f", "v", "f", "function", True), ("v::h", "v", "h", "function", False)], "symbol_id string, file string, name string, kind string, exported boolean")
    edges = e(("w", "u::f"))
    assert got(G.dead_exports(s, edges).select("symbol_id", "confidence")) == [("u::T", "low"), ("u::g", "high"), ("v::f", "high")]
    assert got(G.orphan_types(s, edges).select("symbol_id")) == [("u::T",)]
    assert got(G.duplicates(s)) == [("f", 2, "u,v")]
    assert got(G.file_edges(edges, s)) == [("w", "u")]
    assert got(G.dead_exports(s.where("false"), edges)) == []


def test_arch_rules(e):
    edges = e(("ui/app.ts", "api/service.ts"), ("src/ui/deep/comp.ts", "src/db/repo.ts"), ("lone.ts", "x.ts"))
    rules = [{"id": "a", "from": "ui/*", "forbid": "api/**"}, {"id": "b", "from": "src/ui/**", "forbid": "src/db/*"}, {"id": "c", "from": "lone.ts", "require": "api/*"}, {"id": "d", "from": "none/**", "forbid": "**"}]
    assert [r["rule"] for r in G.arch_rules(edges, rules).orderBy("rule").collect()] == ["a", "b", "c"]
    assert G.arch_rules(edges, []).count() == 0


def test_nearest_ancestor_and_longest_prefix(df):
    files, marks = df([("a/b/c.ts",), ("a/x.ts",), ("top.ts",)], "file string"), df([("a/",), ("a/b/",)], "folder string")
    assert {tuple(r) for r in G.nearest_ancestor(files, marks).collect()} == {("a/b/c.ts", "a/b/"), ("a/x.ts", "a/"), ("top.ts", None)}
    v, p = df([("@app/ui/x",), ("zzz",)], "value string"), df([("@app/",), ("@app/ui/",)], "prefix string")
    assert {tuple(r) for r in G.longest_prefix(v, p).collect()} == {("@app/ui/x", "@app/ui/"), ("zzz", None)}


def test_differences(df, e):
    key = ["file", "qualified_name"]
    old = df([("m", "foo", "f(a)"), ("m", "gone", "g()"), ("m", "same", None)], "file string, qualified_name string, signature string")
    new = df([("m", "foo", "f(a, b)"), ("m", "added", "x()"), ("m", "same", "")], "file string, qualified_name string, signature string")
    d = D.symbol_diff(old, new, key)
    assert got(d.select("qualified_name", "change")) == [("added", "added"), ("foo", "modified"), ("gone", "removed")]
    broken = D.breaking(d, old, key)
    assert broken.count() == 2 and got(D.blast_radius(broken, e(("b", "m"), ("c", "b")))) == [("m", "b", 1), ("m", "c", 2)]
    assert D.symbol_diff(old, old, key).count() == 0


def test_incremental_equals_full(df):
    state, now = df([("a", "1"), ("b", "2"), ("d", "4")], "file string, hash string"), df([("a", "1"), ("b", "3"), ("c", "9")], "file string, hash string")
    assert got(D.changed_files(now, state)) == [("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("d", "deleted")]
    assert {r["status"] for r in D.changed_files(now, None).collect()} == {"changed"}
    build = lambda x: x.select("file", "hash", (x["hash"].cast("int") * 2).alias("v"))
    assert got(D.refresh(build(state), now, build)) == got(build(now))
