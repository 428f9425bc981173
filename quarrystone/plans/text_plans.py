"""Queries of the search and scanning operators over the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import search as S
from quarrystone.plans import adapters as A
from quarrystone.plans.registry import query


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _scan_sql() -> str:
    m = lambda p, c="text": f"regexp_matches({c}, {_quoted(p)})"
    arms = []
    for r in S.RULES:
        if r.id == "no-rate-limit":
            continue
        unless = f" AND NOT {m(r.unless)}" if r.unless else ""
        arms.append(f"SELECT file, line_no, '{r.id}' AS rule, '{r.severity}' AS severity, text FROM code WHERE {m(r.pattern)}{unless}")
    route = next(r for r in S.RULES if r.id == "no-rate-limit")
    arms.append(f"SELECT file, line_no, '{route.id}', '{route.severity}', text FROM near WHERE NOT limited AND {m(route.pattern)} AND NOT {m(S._COMMENT)}")
    return f"""WITH {A.SOURCES_SQL}, code AS (SELECT * FROM sl WHERE NOT {m(S._COMMENT)}),
near AS (SELECT *, coalesce(bool_or({m(S._LIMITER)}) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), false) AS limited FROM sl WHERE {m(route.files, 'file')}),
f AS ({' UNION ALL '.join(arms)}) SELECT file, line_no, rule, severity, left(trim(text, ' '), 120) AS snippet FROM f"""


@query(_scan_sql())
def security_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_files(A.sources(spark, d))


@query(f"WITH {A.SOURCES_SQL} SELECT file, count(*) AS lines, max(length(text)) AS longest FROM sl GROUP BY file")
def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.lines_of(A.sources(spark, d)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("text")).alias("longest"))


_TFIDF = """w AS (SELECT doc_id AS doc, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS length FROM documents),
tc AS (SELECT doc, term, count(*) AS n, any_value(length) AS length FROM w GROUP BY doc, term),
tf AS (SELECT doc, term, n::DOUBLE / length * ln((SELECT count(*)::DOUBLE FROM documents) / df) AS weight FROM tc JOIN (SELECT term, count(*) AS df FROM tc GROUP BY term) USING (term))"""
_WORDS = ["worthless", "the", "und", "worthless"]


def _weights(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    return S.tfidf(S.word_counts(docs, "doc_id", "text"), docs.count())


@query(f"WITH {_TFIDF} SELECT doc, count(*) AS n_terms, round(sqrt(sum(weight * weight)), 6) AS norm FROM tf GROUP BY doc")
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


def _cosine_sql() -> str:
    tf = {t: _WORDS.count(t) / len(_WORDS) for t in _WORDS}
    norm = math.sqrt(sum(x * x for x in tf.values()))
    q = " ".join(f"WHEN '{t}' THEN {v / norm!r}" for t, v in sorted(tf.items()))
    return f"WITH {_TFIDF}, s AS (SELECT doc, sum((CASE term {q} ELSE 0 END)::DOUBLE * weight) AS dot, sqrt(sum(weight * weight)) AS norm FROM tf GROUP BY doc) SELECT doc, round(dot / norm, 6) AS score FROM s WHERE norm > 0 AND dot > 0 ORDER BY score DESC, doc LIMIT 20"


@query(_cosine_sql())
def cosine_search(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_search(_weights(spark, d), _WORDS)


_QUERY = "find small copper gears or locate the rings"


def _part_symbols(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select(A._p("p_partkey", "p").alias("symbol_id"), F.initcap("p_name").alias("qualified_name"), F.lit("const").alias("kind"), F.col("p_type").alias("doc"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("signature"), F.col("p_brand").alias("file"))


def _semantic_sql() -> str:
    wanted = S.concepts(_QUERY)
    fields = (("p_name", 3.0, True), ("p_type", 2.0, False), ("'size' || p_size", 1.5, False), ("p_brand", 1.0, False), ("'const'", 1.0, False))
    arms = " UNION ALL ".join(f"SELECT 'p' || p_partkey AS id, unnest({T.IDENTIFIER_SQL.format(c)}) AS raw, {w} AS weight, {str(n).lower()} AS in_name FROM part" for c, w, n in fields)

    def match(c: str, col: str = "token") -> str:
        group = ", ".join(_quoted(x) for x in S.synonyms_of(c))
        near = f"WHEN length({col}) >= 4 AND levenshtein({col}, '{c}') <= 1 THEN 0.45" if len(c) >= 4 else ""
        return f"CASE WHEN {col} = '{c}' THEN 1.0 {f'WHEN {col} IN ({group}) THEN 0.7' if group else ''} {near} ELSE 0.0 END"

    n = len(wanted)
    aggs = ", ".join(f"max(({match(c)})::DOUBLE * weight) AS m{j}, max((in_name AND token = '{c}')::INT) AS h{j}, max(df{j}) AS df{j}" for j, c in enumerate(wanted))
    dfs = ", ".join(f"(SELECT count(*) FROM g WHERE token = '{c}') AS df{j}" for j, c in enumerate(wanted))
    rest = f"sum((in_name AND greatest({', '.join(match(c) for c in wanted)}, 0.0) = 0)::INT) AS rest"
    base = " + ".join(f"m{j} * ln(1 + (total - df{j} + 0.5) / (df{j} + 0.5))" for j in range(n))
    matched = " + ".join(f"(m{j} > 0)::INT" for j in range(n))
    return f"""WITH a AS ({arms}), g0 AS (SELECT id, {T.stem_sql('raw')} AS token, weight, in_name FROM a),
g AS (SELECT id, token, max(weight)::DOUBLE AS weight, bool_or(in_name) AS in_name FROM g0 WHERE length(token) >= 2 GROUP BY id, token),
k AS (SELECT {dfs}, (SELECT count(*) FROM part)::DOUBLE AS total),
per AS (SELECT id, max(total) AS total, {aggs}, {rest} FROM g, k GROUP BY id),
sc AS (SELECT id, {matched} AS matched, ({base}) * (0.5 + 0.5 * ({matched})::DOUBLE / {n}) * CASE WHEN {' + '.join(f'h{j}' for j in range(n))} = {n} THEN 1.25 ELSE 1.0 END / (1 + 0.15 * rest) * CASE WHEN contains(lower(p_name), '{''.join(wanted)}') THEN 1.2 ELSE 1.0 END AS score FROM per JOIN part ON 'p' || p_partkey = id),
top AS (SELECT * FROM sc WHERE matched > 0 ORDER BY score DESC, id LIMIT 20)
SELECT id AS symbol_id, {T.rounded_sql('score / max(score) OVER ()', 3)} AS score, matched FROM top"""


@query(_semantic_sql())
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return S.semantic_search(_part_symbols(spark, d), _QUERY)


@query("SELECT 'p' || p_partkey AS symbol_id, p_brand AS file FROM part WHERE regexp_matches(p_name, '(?i)^(red|small) .*[gt]$')")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_symbols(_part_symbols(spark, d), "^(red|small) .*[gt]$", "regex").select("symbol_id", "file")


@query(
    f"""WITH x AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n, length(text) AS chars, regexp_matches(text, '[0-9]{{3}}') AS digits FROM documents),
s AS (SELECT lang || '|lines=' || {T.SIZE_SQL.format('n')} || '|chars=' || {T.SIZE_SQL.format('chars // 100')} || '|digits=' || CASE WHEN digits THEN 'yes' ELSE 'no' END AS shape, doc_id::VARCHAR AS item FROM x)
SELECT shape, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM s WHERE shape IS NOT NULL GROUP BY shape HAVING count(*) >= 2"""
)
def similar_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").where("text is not null and lang is not null")
    shape = F.concat(F.col("lang"), F.lit("|lines="), T.size_bucket(F.size(F.split("text", "\n", -1))), F.lit("|chars="), T.size_bucket(F.floor(F.length("text") / 100)), F.lit("|digits="), F.when(F.col("text").rlike("[0-9]{3}"), "yes").otherwise("no"))
    return S.similar_groups(docs.withColumn("item", F.col("doc_id").cast("string")), shape)


@query(f"WITH w AS (SELECT unnest({T.IDENTIFIER_SQL.format('text')}) AS raw FROM documents) SELECT {T.stem_sql('raw')} AS stem, count(*) AS n FROM w GROUP BY 1")
def identifier_stems(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select(F.explode(T.identifier_words(F.col("text"))).alias("raw"))
    return rows.groupBy(T.stem(F.col("raw")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<script[^>]*>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>', 1)) AS body FROM pages)
SELECT page_id, count(*) AS n_scripts, string_agg(body, chr(10) ORDER BY body) AS script FROM s GROUP BY page_id"""
)
def script_lift(spark: SparkSession, d: str) -> DataFrame:
    """The script blocks of every page."""
    body = F.regexp_extract_all("html", F.lit("<script[^>]*>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>"), 1)
    rows = A.table(spark, d, "pages").select("page_id", F.array_sort(body).alias("b")).where(F.size("b") > 0)
    return rows.select("page_id", F.size("b").cast("long").alias("n_scripts"), F.array_join("b", "\n").alias("script"))


@query(f"WITH {A.SOURCES_SQL} SELECT file, left(sha256(content), 16) AS hash, strlen(content) AS size FROM sf WHERE content IS NOT NULL AND strlen(content) <= 2000000")
def content_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of source files: content hash and size of each that isn't above the size limit."""
    return A.sources(spark, d).where(F.octet_length("content") <= 2_000_000).select("file", T.content_key(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"))
