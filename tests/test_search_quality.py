import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import quality as Q
from quarrystone.operators import search as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name,words", [("getHTTPServerByID", "get http server by id"), ("parse_config-v2", "parse config v 2"), ("", ""), ("MAX_RETRIES", "max retries")])
def test_identifier_words(spark, name, words):
    assert one(spark, T.identifier_words(F.lit(name))) == words.split()


@pytest.mark.parametrize("w", ["users", "entries", "running", "hashed", "class", "boxes", "is", "ring", "ed", "passed", "being"])
def test_stem_agrees_with_the_driver_side_one(spark, w):
    assert one(spark, T.stem(F.lit(w))) == S._py_stem(w)


CODE = """import x
eval(input)
// eval(commented)
el.innerHTML = value;
document.write(z)
const h = createHash('md5');
const password = "hunter2hunter2";
const token = "your-key-goes-here";
fetch("http://evil.org/x"); fetch("http://localhost/x")
fetch("http://evil.org/x")
query("SELECT " + name)
exec(cmd + arg)
obj.__proto__ = 1
"""


def test_security_rules(spark):
    files = spark.createDataFrame([("a.js", CODE), ("r.js", "app.get('/x', f)\n"), ("s.js", "const limiter = 1\n\napp.post('/x', f)\n"), ("t.txt", "app.get('/x', f)"), ("n.js", None), ("e.js", "")], "file string, content string")
    rows = {(r["file"], r["line_no"], r["rule"]) for r in S.scan_files(files).collect()}
    assert rows == {("a.js", 2, "eval"), ("a.js", 4, "inner-html"), ("a.js", 5, "document-write"), ("a.js", 6, "weak-crypto"), ("a.js", 7, "hardcoded-secret"), ("a.js", 10, "http-url"), ("a.js", 11, "sql-injection"), ("a.js", 12, "shell-exec"), ("a.js", 13, "prototype-pollution"), ("r.js", 1, "no-rate-limit")}


def test_semantic_search_ranks_the_focused_name_first(spark):
    rows = [("1", "login", "function", "Authenticate a user", "login(user)", "auth.ts"), ("2", "handleLogin", "function", None, "handleLogin(req)", "router.ts"), ("3", "formatDate", "function", None, "formatDate(d)", "util.ts")]
    s = spark.createDataFrame(rows, "symbol_id string, qualified_name string, kind string, doc string, signature string, file string")
    got = S.semantic_search(s, "authenticate user").collect()
    assert got[0]["symbol_id"] == "1" and got[0]["score"] == 1.0 and "3" not in {r["symbol_id"] for r in got}
    assert S.semantic_search(s, "the of a").count() == 0


def test_symbol_search(spark):
    s = spark.createDataFrame([("A.run", "method", True), ("run", "function", False), ("rerun", "function", True)], "qualified_name string, kind string, exported boolean")
    names = lambda *a, **k: sorted(r["qualified_name"] for r in S.search_symbols(s, *a, **k).collect())
    assert names("run", "exact") == ["A.run", "run"] and names("RUN") == ["A.run", "rerun", "run"]
    assert names("^re", "regex") == ["rerun"] and names("run", kind="function", exported_only=True) == ["rerun"]


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c", "c"]), (3, [])], "id int, t array<string>")
    w = S.tfidf(S.term_counts(docs, "id", F.col("t")), 3)
    assert [r["doc"] for r in S.cosine_search(w, ["c"]).collect()] == [2]


def test_fuzzy_pairs_equal_all_pairs(spark):
    names = ["login", "logn", "logins", "lagin", "abcd", "abdc", "xyz", "wxyz"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {tuple(r) for r in S.fuzzy_pairs(df).collect()} == {("login", "logn"), ("login", "logins"), ("lagin", "login")}


def test_complexity(spark):
    spans = spark.createDataFrame([("f", "a", 1, 3), ("g", "a", 5, 11), ("h", "b", 1, 99)], "symbol_id string, file string, start_line int, end_line int")
    d = spark.createDataFrame([("a", n) for n in (5, 6, 7, 8, 11, 12)], "file string, line_no int")
    got = {r["symbol_id"]: (r["complexity"], r["rating"]) for r in Q.complexity(spans, d).collect()}
    assert got == {"f": (1, "low"), "g": (6, "moderate"), "h": (1, "low")}


def test_smells(spark):
    rows = [("C", None, "class", "public", True, 1, 200, None)]
    rows += [(f"C.m{k}", "C", "method", "public", None, k * 10, k * 10 + 2, f"m{k}()") for k in range(11)]
    rows += [("W", None, "class", "public", True, 1, 9, None), ("W.only", "W", "method", "public", None, 2, 4, "only()"), ("H", None, "class", "public", False, 1, 9, None), ("H.only", "H", "method", "public", None, 2, 4, "only()")]
    rows += [("long", None, "function", "public", True, 1, 62, "long(a, b = f(1, 2), {c, d}, e: Map<K, V>)"), ("prim", None, "function", "public", True, 1, 2, "prim(a: string, b: number, c: boolean, d: string, e: number)"), ("hidden", None, "function", "public", False, 1, 100, "hidden(a, b, c, d, e)")]
    s = spark.createDataFrame([("f", *r) for r in rows], "file string, symbol_id string, parent_id string, kind string, visibility string, exported boolean, start_line int, end_line int, signature string")
    files = spark.createDataFrame([("f", 501), ("g", 500)], "file string, lines int")
    got = {(r["symbol_id"], r["smell"]) for r in Q.smells(files, s).collect()}
    assert got == {("C", "god-class"), ("W", "shallow-wrapper"), ("long", "long-method"), ("prim", "long-param-list"), ("prim", "primitive-obsession"), (None, "large-file")}


def test_coverage_map(spark):
    files = spark.createDataFrame([(f,) for f in ("src/core.ts", "src/util.ts", "src/orphanmod.ts", "lib/util.ts", "test/core.test.ts", "src/util.test.ts", "test/e2e-flow.test.ts", "test/fixtures/x.ts")], "file string")
    edges = spark.createDataFrame([("test/core.test.ts", "src/core.ts"), ("src/util.ts", "src/core.ts")], "src string, dst string")
    links = Q.test_map(files, edges)
    assert {tuple(r) for r in links.collect()} == {("test/core.test.ts", "src/core.ts", "import"), ("src/util.test.ts", "src/util.ts", "name")}
    r = Q.coverage_summary(files, links).first()
    assert (r["n_tests"], r["n_sources"], r["n_tested"], r["ratio"], r["n_orphans"]) == (3, 4, 2, 0.5, 1)


def _metrics(spark, **change):
    base = {"dead": 0, "cycles": 0, "very_high": 0, "high": 0, "god_nodes": 0, "sdp": 0, "coverage": 1.0} | change
    return Q.health_score(spark.createDataFrame([tuple(base.values())], list(base)))


def test_score_and_gate(spark):
    assert _metrics(spark).first()["score"] == 100 and _metrics(spark, cycles=9, dead=90, very_high=9, god_nodes=9, sdp=99, coverage=0.0).first()["score"] == 0
    assert _metrics(spark, cycles=1, coverage=0.5).first()["grade"] == "A" and _metrics(spark, cycles=2).first()["grade"] == "B"
    now = _metrics(spark, cycles=1)
    assert Q.quality_gate(now, {}).count() == 0 and Q.quality_gate(now, {"max_cycles": 1}, now).count() == 0
    assert [tuple(r) for r in Q.quality_gate(now, {"max_cycles": 0}).collect()] == [("threshold", "cycles", 0.0, 1.0)]
    kinds = {(r["kind"], r["metric"]) for r in Q.quality_gate(now, {"min_score": 90}, _metrics(spark)).collect()}
    assert kinds == {("regression", "cycles"), ("regression", "score")}


def test_history(spark):
    rows = [(f"2024-01-{d:02d} 0{h}:00:00", float(d * 10 + h)) for d in (1, 2, 4) for h in (1, 2)]
    df = spark.createDataFrame(rows, "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = [(str(r["day"]), r["value"], r["delta"]) for r in Q.daily_history(df, "ts", "v", 2).orderBy("day").collect()]
    assert got == [("2024-01-02", 22.0, None), ("2024-01-04", 42.0, 20.0)]


def test_merge_coverage_falls_back_to_the_name(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("src/c.ts",)], "file string")
    report = spark.createDataFrame([("src/a.ts", 0.8, 0.75), ("build/b.ts", 0.5, None)], "file string, line_cov double, branch_cov double")
    got = {r["file"]: (r["line_cov"], r["branch_cov"], r["matched"]) for r in Q.merge_coverage(files, report).collect()}
    assert got == {"src/a.ts": (0.8, 0.75, "path"), "src/b.ts": (0.5, None, "name"), "src/c.ts": (None, None, None)}


def test_words_are_counted_from_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "_ROWS", 2)
    texts = {1: "The theİx Key 7a\n7A the", 2: None, 3: "", 4: "äö --", 5: "b b B c", None: "n"}
    docs = spark.createDataFrame(list(texts.items()), "id long, t string")
    want = sorted((k, w, n, sum(c.values())) for k, t in texts.items() if t for c in [Counter(w.lower() for w in re.findall("[A-Za-z0-9]+", t))] for w, n in c.items() if k)
    got = [tuple(r) for r in S.word_counts(docs, "id", "t").collect()]
    assert sorted(r for r in got if r[0]) == want and [r for r in got if not r[0]] == [(None, "n", 1, 1)]


def test_rare_terms_weigh_the_same_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(1, 30) if k % j == 0) + " all") for k in range(40)], "id long, t string")
    weights = lambda: sorted((r["doc"], r["term"], round(r["weight"], 12)) for r in S.tfidf(S.word_counts(docs, "id", "t"), 40).collect())
    want = weights()
    monkeypatch.setattr(S, "HOT_TERMS", 3)
    assert weights() == want and len(want) > 100
