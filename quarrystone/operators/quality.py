"""Complexity, rules, smells, coverage, score, gate and history operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import basename, grade, rating, rounded

# Complexity


def complexity(spans: DataFrame, decisions: DataFrame, key: str = "file", start: str = "start_line", end: str = "end_line", at: str = "line_no", ident: str = "symbol_id") -> DataFrame:
    """(ident, key, complexity, rating): one more than the decision points within each span.

    An equi-join on the key with the interval as residual, so a file's spans meet its own
    decisions only; spans without any are kept.
    """
    d = decisions.select(F.col(key).alias("__k"), F.col(at).alias("__at"))
    inside = (F.col(key) == F.col("__k")) & F.col("__at").between(F.col(start), F.col(end))
    counted = spans.join(d, inside).groupBy(ident).agg(F.count(F.lit(1)).alias("__n"))
    n = (F.coalesce("__n", F.lit(0)) + 1).alias("complexity")
    return spans.select(ident, key).distinct().join(counted, ident, "left").select(ident, key, n).withColumn("rating", rating(F.col("complexity")))


def file_complexity(files: DataFrame, per_span: DataFrame, key: str = "file") -> DataFrame:
    """(key, max_complexity, avg_complexity) of every file; 0 where it has no span."""
    agg = per_span.groupBy(key).agg(F.max("complexity").alias("m"), rounded(F.avg("complexity"), 1).alias("a"))
    return files.select(key).distinct().join(agg, key, "left").select(key, F.coalesce("m", F.lit(0)).alias("max_complexity"), F.coalesce("a", F.lit(0.0)).alias("avg_complexity"))


def risk_map(churn: DataFrame, complexity_: DataFrame, key: str = "file") -> DataFrame:
    """(key, churn, complexity, risk): changes times complexity, where positive."""
    rows = churn.join(complexity_, key).withColumn("risk", F.col("churn") * F.col("complexity"))
    return rows.where("risk > 0").select(key, "churn", "complexity", "risk")


# Rules and smells


def general_rules(metrics: DataFrame, limits: dict[str, float], key: str = "file") -> DataFrame:
    """(key, rule, value, threshold): each metric column that exceeds its limit."""
    rows = F.filter(F.array(*(F.when(F.col(m) > lim, F.struct(F.lit(m).alias("rule"), F.col(m).cast("double").alias("value"), F.lit(float(lim)).alias("threshold"))) for m, lim in sorted(limits.items()))), lambda x: x.isNotNull())
    return metrics.select(key, F.explode(rows).alias("x")).select(key, "x.*")


FILE_LIMITS = {"lines": 500, "imports": 15, "exports": 10}


def parameter_list(signature: Column) -> Column:
    """The parameters of a signature, split at commas outside brackets; null without a parameter list.

    One pass over the signs counts how many brackets are open, to any depth; commas within
    brackets become another sign, and what follows the list's own closing bracket is left out.
    """
    s = F.regexp_replace(F.regexp_extract(signature, r"(?s)[(](.*)$", 1), "[-=]>", "~")
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(acc: Column, c: Column) -> Column:
        opens, closes = c.isin("(", "[", "{", "<"), c.isin(")", "]", "}", ">")
        done = acc["depth"] < 0
        depth = F.when(done, acc["depth"]).when(opens, acc["depth"] + 1).when(closes, acc["depth"] - 1).otherwise(acc["depth"])
        kept = F.when(done | (depth < 0), acc["text"]).when((c == ",") & (acc["depth"] > 0), F.concat(acc["text"], F.lit(";"))).otherwise(F.concat(acc["text"], c))
        return F.struct(depth.alias("depth"), kept.alias("text"))

    inner = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), state, step, lambda acc: acc["text"])
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != "this") & ~p.startswith("this:"))
    return F.when(signature.rlike(r"(?s)[(].*[)]"), parts)


_PRIMITIVE = r"^[^:]*:\s*(string|number|boolean|str|int|float|bool)(\s*[|]\s*(string|number|boolean|null|undefined|str|int|float|bool|None))*(\[\])?\s*(=.*)?$"
SMELL_LIMITS = {"file_lines": 500, "methods": 10, "fields": 8, "method_lines": 60, "params": 4, "wrapper_lines": 5}


def smells(files: DataFrame, symbols: DataFrame, limits: dict[str, int] = SMELL_LIMITS) -> DataFrame:
    """(file, symbol_id, smell, severity, value): six smells of files(file, lines) and symbols.

    Only exported symbols and children of exported ones are looked at; ``exported`` is null for
    a symbol without a mark of its own, which then has its parent's.
    """
    parent = symbols.select(F.col("symbol_id").alias("parent_id"), F.col("exported").alias("__above"))
    s = symbols.join(parent, "parent_id", "left").withColumn("__above", F.coalesce("__above", F.lit(False)))
    s = s.where(F.coalesce("exported", "__above") | F.col("__above")).withColumn("length", F.col("end_line") - F.col("start_line"))
    method = F.col("kind").isin("method", "function") & (F.col("visibility") == "public")
    below = symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("symbol_id")).agg(
        F.count_if(method).alias("n_methods"), F.count_if(F.col("kind") == "field").alias("n_fields"), F.max(F.when(method, F.col("end_line") - F.col("start_line"))).alias("one_length")
    )
    s = s.join(below, "symbol_id", "left").na.fill(0, ["n_methods", "n_fields"])
    is_class, callable_ = F.col("kind") == "class", F.col("kind").isin("method", "function")
    params = parameter_list(F.col("signature"))
    n = F.coalesce(F.size(params), F.lit(-1))
    hit = lambda test, name, level, value: F.when(test, F.struct(F.lit(name).alias("smell"), F.lit(level).alias("severity"), value.cast("long").alias("value")))
    god = F.when(F.col("n_methods") > limits["methods"], F.col("n_methods")).when(F.col("n_fields") > limits["fields"], F.col("n_fields"))
    found = F.array(
        hit(is_class & god.isNotNull(), "god-class", "warning", god),
        hit(is_class & (F.col("n_methods") == 1) & (F.col("one_length") <= limits["wrapper_lines"]), "shallow-wrapper", "info", F.col("one_length")),
        hit(callable_ & (F.col("length") > limits["method_lines"]), "long-method", "warning", F.col("length")),
        hit(callable_ & (n > limits["params"]), "long-param-list", "warning", n),
        hit(callable_ & (n > 3) & F.forall(params, lambda p: p.rlike(_PRIMITIVE)), "primitive-obsession", "info", n),
    )
    own = s.select("file", "symbol_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("file", "symbol_id", "x.*")
    large = files.where(F.col("lines") > limits["file_lines"]).select("file", F.lit(None).cast("string").alias("symbol_id"), F.lit("large-file").alias("smell"), F.lit("warning").alias("severity"), F.col("lines").cast("long").alias("value"))
    return own.unionByName(large)


def unused_params(params: DataFrame, uses: DataFrame) -> DataFrame:
    """Parameters (file, fn, name) that no identifier use (file, fn, name) names; _x, self, cls and this are skipped."""
    real = params.where(~F.col("name").startswith("_") & ~F.col("name").isin("self", "this", "cls"))
    return real.join(uses.select("file", "fn", "name").distinct(), ["file", "fn", "name"], "left_anti").select("file", "fn", "name")


def type_roles(type_refs: DataFrame, type_name: str) -> DataFrame:
    """(role, n): how often a type occurs as parameter, result, variable or field."""
    return type_refs.where(F.col("type_name") == type_name).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


FIXES = (("dead-export", "remove-export", 2), ("long-method", "extract-method", 3), ("god-class", "split-class", 2), ("eval", "remove-eval", 1), ("http-url", "use-https", 3), ("no-rate-limit", "add-rate-limit", 1))


def fix_suggestions(findings: DataFrame, max_priority: int = 3) -> DataFrame:
    """Findings (file, rule, ...) that have a known fix, with its kind and priority."""
    known = findings.sparkSession.createDataFrame(list(FIXES), "rule string, fix string, priority int")
    return findings.join(F.broadcast(known), "rule").where(F.col("priority") <= max_priority)


# Test coverage

_TEST_DIR = "(?i)(^|/)(tests?|__tests__|specs?|testing|e2e|integration-tests)/"
_FIXTURE_DIR = "(?i)(^|/)(fixtures?|__fixtures__|mocks|__mocks__|testdata|snapshots|__snapshots__)/"
_TEST_BASE = r"(?i)[.](spec|test)[.][^.]+$|[-_](spec|tests?)[.][^.]+$|^(spec|test)[-_]"
_TEST_CAMEL = r"(Spec|Tests?)[.](cs|java|kts?|scala|swift)$"


def is_test(path: Column) -> Column:
    base = basename(path)
    return path.rlike(_TEST_DIR) | base.rlike(_TEST_BASE) | base.rlike(_TEST_CAMEL)


def is_fixture(path: Column) -> Column:
    return path.rlike(_FIXTURE_DIR)


def test_target(path: Column) -> Column:
    """The base name that a test's name points at; null if it names none."""
    bare = F.regexp_replace(basename(path), "[.][^.]+$", "")
    t = F.regexp_replace(bare, "(?i)[.](spec|test)$", "")
    t = F.regexp_replace(t, "(?i)[-_](spec|tests|test|smoke)$", "")
    t = F.regexp_replace(t, "(?i)[.]smoke$", "")
    t = F.regexp_replace(t, "(?i)^(spec|test)[-_]", "")
    t = F.regexp_replace(t, "(Tests|Test|Spec)$", "")
    return F.when((t != bare) & (t != ""), t)


def test_map(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, source, how): a test covers the sources it imports, else those its name points at in the nearest folder (ties kept)."""
    own = files.where(~is_fixture(F.col("file"))).select("file", is_test(F.col("file")).alias("t"))
    tests, sources = own.where("t").select(F.col("file").alias("test")), own.where("not t").select(F.col("file").alias("source"))
    direct = edges.select(F.col("src").alias("test"), F.col("dst").alias("source")).join(tests, "test", "left_semi").join(own.where("t").select(F.col("file").alias("source")), "source", "left_anti").select("test", "source").distinct()
    named = tests.withColumn("__base", test_target(F.col("test"))).join(sources.withColumn("__base", F.regexp_replace(basename(F.col("source")), "[.][^.]+$", "")), "__base")
    dirs = lambda c: F.slice(F.split(c, "/"), F.lit(1), F.size(F.split(c, "/")) - 1)
    same = F.zip_with(dirs(F.col("test")), dirs(F.col("source")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    best = Window.partitionBy("test").orderBy(F.desc("__common"))
    by_name = named.withColumn("__common", common).withColumn("__r", F.rank().over(best)).where("__r = 1").select("test", "source")
    by_name = by_name.join(direct.select("test", "source"), ["test", "source"], "left_anti")
    return direct.withColumn("how", F.lit("import")).unionByName(by_name.withColumn("how", F.lit("name")))


def coverage_summary(files: DataFrame, links: DataFrame) -> DataFrame:
    """One row: n_tests, n_sources, n_tested, ratio (two places, 1 without sources), n_orphans."""
    own = files.where(~is_fixture(F.col("file"))).select("file", is_test(F.col("file")).alias("t"))
    tested = links.select(F.col("source").alias("file"), F.lit(True).alias("__hit")).distinct()
    linked = links.select(F.col("test").alias("file"), F.lit(True).alias("__on")).distinct()
    rows = own.join(tested, "file", "left").join(linked, "file", "left")
    n = rows.agg(F.count_if("t").alias("n_tests"), F.count_if(~F.col("t")).alias("n_sources"), F.count_if(~F.col("t") & F.col("__hit").isNotNull()).alias("n_tested"), F.count_if(F.col("t") & F.col("__on").isNull()).alias("n_orphans"))
    return n.withColumn("ratio", F.when(F.col("n_sources") > 0, rounded(F.col("n_tested") / F.col("n_sources"), 2)).otherwise(1.0))


def merge_coverage(files: DataFrame, report: DataFrame) -> DataFrame:
    """(file, line_cov, branch_cov, matched): a report's ratios under full, then base names.

    ``report`` has file, line_cov and branch_cov and may have a column n, the row's place in the report; a name
    that occurs twice counts by its last row (without n, that of the greatest path, then the greatest ratios).
    """
    last = F.struct(*(["n"] if "n" in report.columns else []), "file", "line_cov", "branch_cov")
    full = report.groupBy("file").agg(F.max_by("line_cov", last).alias("l1"), F.max_by("branch_cov", last).alias("b1"), F.lit("path").alias("m1"))
    base = report.groupBy(basename(F.col("file")).alias("__base")).agg(F.max_by("line_cov", last).alias("l2"), F.max_by("branch_cov", last).alias("b2"), F.lit("name").alias("m2"))
    rows = files.select("file").distinct().join(full, "file", "left").withColumn("__base", basename(F.col("file"))).join(base, "__base", "left")
    return rows.select("file", F.when(F.col("m1").isNotNull(), F.col("l1")).otherwise(F.col("l2")).alias("line_cov"), F.when(F.col("m1").isNotNull(), F.col("b1")).otherwise(F.col("b2")).alias("branch_cov"), F.coalesce("m1", "m2").alias("matched"))


# Score, gate, history


def health_score(metrics: DataFrame) -> DataFrame:
    """The metrics row plus score (0 to 100) and grade.

    Columns: dead, cycles, very_high, high, god_nodes, sdp, coverage.
    """
    c = F.col
    lost = (
        F.least(F.lit(20.0), 1.5 * c("dead"))
        + F.least(F.lit(22.0), 6.0 * c("cycles"))
        + F.least(F.lit(28.0), 4.0 * c("very_high") + c("high"))
        + F.least(F.lit(12.0), 4.0 * c("god_nodes"))
        + F.least(F.lit(10.0), c("sdp").cast("double"))
        + F.least(F.lit(8.0), F.round(8.0 * (1.0 - c("coverage"))))
    )
    score = F.round(F.greatest(F.lit(0.0), F.lit(100.0) - lost)).cast("int")
    return metrics.withColumn("score", score).withColumn("grade", grade(F.col("score")))


RATCHET = ("cycles", "dead", "sdp", "very_high")


def quality_gate(metrics: DataFrame, thresholds: dict[str, float], baseline: DataFrame | None = None) -> DataFrame:
    """(kind, metric, bound, actual) of every failure: absolute thresholds (max_x, min_x) and regressions from a baseline."""
    tests = []
    for name, bound in sorted(thresholds.items()):
        side, _, metric = name.partition("_")
        bad = F.col(metric) > bound if side == "max" else F.col(metric) < bound
        tests.append(F.when(bad, F.struct(F.lit("threshold").alias("kind"), F.lit(metric).alias("metric"), F.lit(float(bound)).alias("bound"), F.col(metric).cast("double").alias("actual"))))
    rows = metrics
    if baseline is not None:
        rows = metrics.crossJoin(baseline.select(*(F.col(x).alias(f"__{x}") for x in (*RATCHET, "score"))))
        for metric in (*RATCHET, "score"):
            bad = F.col(metric) < F.col("__score") if metric == "score" else F.col(metric) > F.col(f"__{metric}")
            tests.append(F.when(bad, F.struct(F.lit("regression").alias("kind"), F.lit(metric).alias("metric"), F.col(f"__{metric}").cast("double").alias("bound"), F.col(metric).cast("double").alias("actual"))))
    if not tests:
        return metrics.sparkSession.createDataFrame([], "kind string, metric string, bound double, actual double")
    return rows.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")).select("x.*")


def daily_history(entries: DataFrame, at: str, value: str, keep: int = 30) -> DataFrame:
    """(day, value, delta): each day's last value, the last ``keep`` days, and the change from the day before in the list.

    Grouping leaves one row a day, so the window over all days sees days, not entries.
    """
    last = entries.groupBy(F.to_date(at).alias("day")).agg(F.max_by(value, F.struct(F.col(at), F.col(value))).alias("value"))
    newest = last.orderBy(F.desc("day")).limit(keep)
    return newest.withColumn("delta", F.round(F.col("value") - F.lag("value").over(Window.partitionBy().orderBy("day")), 4))
