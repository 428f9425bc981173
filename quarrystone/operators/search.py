"""Search and scanning operators: line rules, TF-IDF, semantic search, symbol search, similar shapes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import identifier_words, rounded, size_bucket, stem
from quarrystone.session import materialize, ship


def lines_of(texts: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """(file, line_no, text): one row a line, numbered from 1; nothing for a null text."""
    return texts.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "text")).select("file", (F.col("n") + 1).alias("line_no"), "text")


@dataclass(frozen=True)
class LineRule:
    """A rule over one line; patterns are in the common part of Java's and RE2's syntax.

    ``needs``: small letters of which some must occur in the line, whatever its case; the pattern is tried on such lines only.
    """

    id: str
    severity: str
    pattern: str
    unless: str | None = None
    files: str | None = None
    needs: tuple[str, ...] = ()


_Q = "['\"]"
_START = "(^|[^A-Za-z0-9_])"
RULES: tuple[LineRule, ...] = (
    LineRule("eval", "critical", _START + r"eval[ \t]*[(]", _START + r"eval[ \t]*[.][ \t]*[A-Za-z0-9_]", needs=("eval",)),
    LineRule("inner-html", "high", r"[.]innerHTML[ \t]*=[^+=]", needs=("innerhtml",)),
    LineRule("document-write", "high", _START + r"document[ \t]*[.][ \t]*write[ \t]*[(]", needs=("document",)),
    LineRule("dangerously-set-inner-html", "high", "dangerouslySet" + "InnerHTML", needs=("dangerouslysetinnerhtml",)),
    LineRule("child-process", "medium", f"require[ \\t]*[(][ \\t]*{_Q}child_process{_Q}|import[ \\t].*{_START}child_process", needs=("child_process",)),
    LineRule("shell-exec", "high", _START + r"exec(Sync)?[ \t]*[(][ \t]*([`$]|[A-Za-z0-9_]+[ \t]*[,+)])", needs=("exec",)),
    LineRule("weak-crypto", "medium", f"(?i)createHash[ \\t]*[(][ \\t]*{_Q}(sha1|md5){_Q}", needs=("createhash",)),
    LineRule("hardcoded-secret", "high", f"(?i)(passwd|password|token|secret|api_?key)[ \\t]*[:=][ \\t]*{_Q}[^'\"]{{8,}}{_Q}", "(?i)(changeme|dummy|example|fake|mock|placeholder|sample|test|your[-_]?key|xxx|<|>|[*])", needs=("passwd", "password", "token", "secret", "apikey", "api_key")),
    LineRule("sql-injection", "high", _START + r"(execute|query)[ \t]*[(][^)]*[+]", needs=("execute", "query")),
    LineRule("http-url", "low", "[\"'`]http://", "[\"'`]http://(localhost|example[.]com|schema[.]org|127[.]0[.]0[.]1|0[.]0[.]0[.]0)", needs=("http://",)),
    LineRule("no-rate-limit", "medium", r"[.][ \t]*(all|delete|get|patch|post|put)[ \t]*[(][ \t]*[\"'`]", files="[.][jt]sx?$", needs=("all", "delete", "get", "patch", "post", "put")),
    LineRule("prototype-pollution", "high", "__proto__|constructor[ \\t]*[.][ \\t]*prototype|Object[.]assign[ \\t]*[(][ \\t]*[{][ \\t]*[}][^)]*(user|data|input|body|params|req)", needs=("__proto__", "constructor", "assign")),
)
_COMMENT = r"^[ \t]*(//|#|[*]|/[*])"
_LIMITER = "(?i)(limiter|throttle|rateLimit)"


def scan_files(texts: DataFrame, rules: Iterable[LineRule] = RULES, near: int = 5, file: str = "file", text: str = "content") -> DataFrame:
    """(file, line_no, rule, severity, snippet): every rule on every line, nothing shuffled.

    Lines stay in their file's row until one of the rules' letters is found in them; patterns run on those only.
    Comment lines are skipped.  A route without a limiter is reported unless a limiter
    keyword stands within ``near`` lines, which are at hand in the same row.
    """
    rules = list(rules)
    low = lambda c: F.lower(c)
    any_of = lambda tests: reduce(or_, tests, F.lit(False))
    letters = sorted({w for r in rules for w in r.needs})
    may = (lambda c: any_of(F.contains(low(c), F.lit(w)) for w in letters)) if all(r.needs for r in rules) else (lambda _: F.lit(True))
    routes = any(r.id == "no-rate-limit" for r in rules)
    numbered = F.filter(F.transform(F.col("__lines"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"))), lambda s: may(s["text"]))
    limited = lambda n: F.exists(F.slice(F.col("__lines"), F.greatest(n - near, F.lit(1)), n + near + 1 - F.greatest(n - near, F.lit(1))), lambda x: x.rlike(_LIMITER))
    found = F.transform(numbered, lambda s: F.struct(s["n"].alias("line_no"), s["text"].alias("text"), (limited(s["n"]) if routes else F.lit(False)).alias("limited")))
    held = texts.select(F.col(file).alias("file"), F.col(text).alias("__text")).where(may(F.col("__text")))
    rows = held.select("file", F.split("__text", "\n", -1).alias("__lines")).select("file", F.explode(found).alias("x")).select("file", "x.*").where(~F.col("text").rlike(_COMMENT))

    def hit(r: LineRule) -> Column:
        c = F.col("text").rlike(r.pattern)
        if r.unless:
            c = c & ~F.col("text").rlike(r.unless)
        if r.files:
            c = c & F.col("file").rlike(r.files)
        if r.id == "no-rate-limit":
            c = c & ~F.col("limited")
        return (any_of(F.contains(low(F.col("text")), F.lit(w)) for w in r.needs) & c) if r.needs else c

    findings = F.array_compact(F.array(*(F.when(hit(r), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules)))
    hits = rows.select("file", "line_no", "text", F.explode(findings).alias("f"))
    return hits.select("file", "line_no", "f.rule", "f.severity", F.left(F.trim("text"), F.lit(120)).alias("snippet"))


# TF-IDF


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(doc, term, n, length) from an array column of tokens: counted within the row, so nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc"), F.size(tokens).alias("length"), F.sort_array(tokens).alias("__t")).where("length > 0")
    at = lambda k: F.element_at(F.col("__t"), k)
    # where a run of equal tokens begins; the next run's beginning ends it
    starts = F.filter(F.sequence(F.lit(1), F.col("length")), lambda k: (k == 1) | (at(k) != at(F.greatest(k - 1, F.lit(1)))))
    runs = rows.select("doc", "length", "__t", starts.alias("__s"))
    pairs = F.arrays_zip(F.transform("__s", at).alias("term"), F.zip_with(F.slice(F.concat("__s", F.array(F.col("length") + 1)), F.lit(2), F.size("__s")), "__s", lambda b, a: b - a).alias("n"))
    return runs.select("doc", "length", F.explode(pairs).alias("x")).select("doc", F.col("x.term").alias("term"), F.col("x.n").cast("long").alias("n"), "length")


def word_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, term, n, length): ``term_counts`` of the runs of ASCII letters and digits in a text, in small letters.

    A document is counted at once from its bytes, without a row for each word.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text).cast("binary").alias("text"))
    return held.mapInArrow(_count_words, f"doc {kind}, term string, n long, length long")


#: Bytes of words: capitals become small, all that is no ASCII letter or digit becomes a blank.
_WORD_BYTES = bytes(ord(c.lower()) if c.isascii() and c.isalnum() else 32 for c in map(chr, range(256)))
_ROWS = 100_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, at, sizes, lengths, terms, ns = batch.schema.field(0).type, [], [], [], [], []

        def rows() -> pa.RecordBatch:
            doc = batch.column(0).take(pa.array(np.repeat(at, sizes)))  # noqa: B023
            term = pa.array(terms, pa.binary()).cast(pa.string())  # noqa: B023
            return pa.RecordBatch.from_arrays([doc.cast(kind), term, pa.array(ns, pa.int64()), pa.array(np.repeat(lengths, sizes))], ["doc", "term", "n", "length"])  # noqa: B023

        for k, text in enumerate(batch.column(1)):
            words = text.as_py().translate(_WORD_BYTES).split()
            if not words:
                continue
            counted = Counter(words)
            at.append(k)
            sizes.append(len(counted))
            lengths.append(len(words))
            terms.extend(counted.keys())
            ns.extend(counted.values())
            if len(terms) >= _ROWS:
                yield rows()
                at, sizes, lengths, terms, ns = [], [], [], [], []
        if terms:
            yield rows()


#: Terms whose document counts every task holds at most; the others, each in few documents, are joined by a shuffle.
HOT_TERMS = 262_144


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(doc, term, weight): tf = n / length, idf = ln(N / df).

    The document counts are written first.  Those of the ``HOT_TERMS`` terms in most documents are sent to every task,
    so most rows stay where they are; only the rest of the rows are shuffled.
    """
    df, _ = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    if df.count() <= HOT_TERMS:
        joined = counts.join(F.broadcast(df), "term")
    else:
        hot, _ = materialize(df.orderBy(F.desc("df"), "term").limit(HOT_TERMS), "hot")
        cold, _ = materialize(df.join(F.broadcast(hot.select("term")), "term", "left_anti"), "cold")
        joined = counts.join(F.broadcast(hot), "term").unionByName(counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(cold, "term"))
    return joined.select("doc", "term", (F.col("n") / F.col("length") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("weight"))


def cosine_search(weights: DataFrame, query: list[str], k: int = 20) -> DataFrame:
    """(doc, score): the ``k`` documents with the greatest cosine to the raw term frequencies of ``query``."""
    tf = {t: query.count(t) / len(query) for t in query}
    norm = math.sqrt(sum(x * x for x in tf.values()))
    q = F.create_map(*(x for t, v in sorted(tf.items()) for x in (F.lit(t), F.lit(v / norm))))
    part = weights.groupBy("doc").agg(F.sum(F.coalesce(q[F.col("term")], F.lit(0.0)) * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scored = part.where("norm > 0 and dot > 0").select("doc", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(k)


# Semantic search

STOP = frozenset("a an and are as at be by code do does for from function how i in is it its method of on or something stuff that the thing this to we what when where which with you".split())
#: Words that stand for one another; each row is one group.
SYNONYMS: tuple[str, ...] = (
    "login signin authenticate auth logon",
    "logout signout logoff",
    "delete remove erase drop destroy discard",
    "create new make build add construct",
    "get fetch load read retrieve obtain",
    "set write store save put persist",
    "update modify change edit patch alter",
    "find search lookup query locate",
    "error exception failure fault",
    "user account member customer client",
    "start begin init launch open boot",
    "stop end finish close halt terminate",
    "check validate verify assert test",
    "config setting option preference",
    "parse decode read interpret",
    "render draw display show paint",
    "send emit dispatch publish post",
    "receive listen subscribe accept",
    "list array collection items",
    "map dict dictionary table hash",
    "file document path",
    "folder directory dir",
    "token session credential key secret",
    "password passphrase pin pwd",
    "count number total size length",
    "price cost amount fee",
    "order purchase buy",
    "message msg note text",
    "image picture photo",
    "time date timestamp clock",
    "cache memo buffer",
    "job task work",
    "graph network tree",
    "route path url endpoint",
    "convert transform translate map",
    "merge join combine concat union",
    "split divide cut slice",
    "copy clone duplicate",
    "sort order rank",
    "filter select where",
    "lock mutex semaphore guard",
    "retry repeat again backoff",
    "encrypt cipher encode hash obfuscate",
    "decrypt decipher",
    "permission role grant privilege access",
    "database db storage repository",
    "schema model entity",
    "request req call query",
    "response reply answer result",
    "event signal trigger hook",
    "queue stack fifo backlog",
    "thread worker process",
    "sort rank arrange",
    "filter select pick exclude",
    "log trace record audit",
    "debug inspect diagnose",
    "import require include",
    "export expose share",
    "enable activate allow",
    "disable deactivate deny",
    "show reveal visible",
)


def _py_stem(w: str) -> str:
    undouble = lambda s: s[:-1] if len(s) >= 2 and s[-1] == s[-2] and s[-1].isalpha() else s
    n = len(w)
    if w.endswith("ies") and n > 4:
        return w[:-3] + "y"
    if w.endswith("ing") and n > 4:
        return undouble(w[:-3])
    if w.endswith("ed") and n > 4:
        return undouble(w[:-2])
    if w.endswith("es") and n > 3:
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") and n > 3 else w


def concepts(query: str) -> list[str]:
    """The distinct stems of a query without its stop words, in order."""
    import re

    s = re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", re.sub("[^A-Za-z0-9]+", " ", query))
    out: list[str] = []
    for w in s.lower().split():
        t = _py_stem(w)
        if w not in STOP and len(t) >= 2 and t not in out:
            out.append(t)
    return out


def synonyms_of(concept: str) -> list[str]:
    found: set[str] = set()
    for row in SYNONYMS:
        group = {x for w in row.split() for x in (w, _py_stem(w))}
        if concept in group:
            found |= group
    return sorted(found - {concept})


FIELD_WEIGHTS = {"name": 3.0, "doc": 2.0, "signature": 1.5, "path": 1.0, "kind": 1.0}


def symbol_tokens(symbols: DataFrame) -> DataFrame:
    """(symbol_id, token, weight, in_name): the stems of every symbol's fields, each with its best field's weight."""
    path = F.col("file")
    words = lambda c, field: F.transform(identifier_words(F.coalesce(c, F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(FIELD_WEIGHTS[field]).alias("weight"), F.lit(field == "name").alias("in_name")))
    every = F.concat(words(F.col("qualified_name"), "name"), words(F.col("doc"), "doc"), words(F.col("signature"), "signature"), words(path, "path"), words(F.col("kind"), "kind"))
    rows = symbols.select("symbol_id", F.explode(every).alias("x")).select("symbol_id", stem(F.col("x.w")).alias("token"), "x.weight", "x.in_name")
    return rows.where(F.length("token") >= 2).groupBy("symbol_id", "token").agg(F.max("weight").alias("weight"), F.max("in_name").alias("in_name"))


def semantic_search(symbols: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(symbol_id, score, matched): symbols by meaning.

    A concept of the query matches a token directly (1), by a synonym (0.7) or within one edit (0.45),
    times the field's weight; the best match of each concept counts with its inverse document
    frequency.  The query side is small and becomes literals, so the token table is read once.
    """
    wanted = concepts(query)
    if not wanted:
        return symbols.sparkSession.createDataFrame([], "symbol_id string, score double, matched int")
    tokens, _ = materialize(symbol_tokens(symbols), "tokens")
    n_docs = symbols.select("symbol_id").distinct().count()
    df = {r["token"]: r["n"] for r in tokens.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    long = lambda c: F.lit(len(c) >= 4) & (F.length("token") >= 4)

    def match(c: str) -> Column:
        near = long(c) & (F.levenshtein(F.col("token"), F.lit(c), 1) >= 0)
        return F.when(F.col("token") == c, 1.0).when(F.col("token").isin(synonyms_of(c)), 0.7).when(near, 0.45).otherwise(0.0)

    idf = {c: math.log(1 + (n_docs - df.get(c, 0) + 0.5) / (df.get(c, 0) + 0.5)) for c in wanted}
    aggs = [F.max(match(c) * F.col("weight")).alias(f"m{j}") for j, c in enumerate(wanted)]
    names = [F.max(F.col("in_name") & (F.col("token") == c)).cast("int").alias(f"h{j}") for j, c in enumerate(wanted)]
    explained = F.greatest(*(match(c) for c in wanted), F.lit(0.0)) > 0
    rest = F.sum((F.col("in_name") & ~explained).cast("int")).alias("rest")
    per = tokens.groupBy("symbol_id").agg(*aggs, *names, rest)
    total = lambda p, f=lambda c, _: c: sum((f(F.col(f"{p}{j}"), c) for j, c in enumerate(wanted)), F.lit(0.0))
    matched = sum(((F.col(f"m{j}") > 0).cast("int") for j in range(len(wanted))), F.lit(0))
    base = total("m", lambda m, c: m * F.lit(idf[c])) * (0.5 + 0.5 * matched / len(wanted))
    base = base * F.when(total("h") == len(wanted), 1.25).otherwise(1.0)
    scored = per.withColumn("matched", matched).where("matched > 0").withColumn("__score", base / (1 + 0.15 * F.col("rest")))
    named = scored.join(symbols.select("symbol_id", "qualified_name").distinct(), "symbol_id")
    flat = F.when(F.contains(F.lower("qualified_name"), F.lit("".join(wanted))), 1.2).otherwise(1.0)
    top = named.withColumn("__score", F.col("__score") * flat).orderBy(F.desc("__score"), "symbol_id").limit(k)
    return top.select("symbol_id", rounded(F.col("__score") / F.max("__score").over(Window.partitionBy()), 3).alias("score"), "matched")


# Symbols


def search_symbols(symbols: DataFrame, pattern: str, mode: str = "contains", kind: str | None = None, exported_only: bool = False) -> DataFrame:
    """Symbols by qualified name: ``exact`` (or the last part), ``contains`` or ``regex``, the last two without case."""
    q = F.col("qualified_name")
    if mode == "exact":
        test = (q == pattern) | q.endswith("." + pattern)
    elif mode == "contains":
        test = F.contains(F.lower(q), F.lit(pattern.lower()))
    elif mode == "regex":
        test = q.rlike("(?i)" + pattern)
    else:
        raise ValueError(f"no such mode: {mode}")
    if kind is not None:
        test = test & (F.col("kind") == kind)
    if exported_only:
        test = test & F.col("exported")
    return symbols.where(test)


def similar_groups(items: DataFrame, shape: Column, at_least: int = 2, item: str = "item") -> DataFrame:
    """(shape, n_items, items): items of equal shape, sorted, where there are enough."""
    grouped = items.groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"))
    return grouped.where(F.col("n_items") >= at_least)


def symbol_shape() -> Column:
    """The structural fingerprint of a row of ``symbols`` that also has n_children and has_nested."""
    sig = F.coalesce("signature", F.lit(""))
    inner = F.trim(F.regexp_extract(sig, r"[(]([^)]*)[)]", 1))
    params = F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))
    children = F.when(F.col("n_children") == 0, "0").when(F.col("n_children") <= 3, "1-3").when(F.col("n_children") <= 8, "4-8").otherwise("9+")
    size = size_bucket(F.col("end_line") - F.col("start_line") + 1)
    typed = sig.contains("): ") | sig.contains(") :") | sig.contains("->")
    slow = sig.contains("async ") | sig.contains("suspend ")
    text = lambda c: F.when(c, "yes").otherwise("no")
    classy = F.concat_ws("|", "kind", F.concat(F.lit("children="), children), F.concat(F.lit("vis="), "visibility"), F.concat(F.lit("size="), size))
    callable_ = F.concat_ws("|", "kind", F.concat(F.lit("params="), params.cast("string")), F.concat(F.lit("async="), text(slow)), F.concat(F.lit("returns="), text(typed)), F.concat(F.lit("vis="), "visibility"), F.concat(F.lit("size="), size), F.concat(F.lit("nested="), text(F.col("has_nested"))))
    return F.when(F.col("kind").isin("class", "struct"), classy).otherwise(callable_)


def fuzzy_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """(a, b), a < b: distinct names of 4 letters or more within one edit.

    Two names within one edit share the whole name or one of its single-letter deletions, so
    the pairs come from an equi-join on deletion variants and are then verified.
    """
    rows = names.select(F.col(name).alias("v")).where(F.length(name) >= 4).distinct()
    variants = F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.concat(F.left("v", i - 1), F.substr(F.col("v"), i + 1)))
    keyed = rows.select("v", F.explode(F.array_distinct(F.concat(F.array("v"), variants))).alias("key"))
    other = keyed.select(F.col("v").alias("b"), "key")
    return keyed.withColumnRenamed("v", "a").join(other, "key").where("a < b").select("a", "b").distinct().where(F.levenshtein("a", "b", 1) >= 0)
