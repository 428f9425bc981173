"""The driver's tables seen as the engine's canonical relations, whole tables each, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _p(c: str, prefix: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# Parts as files; a line of an order imports the part of the order's next line.


def part_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(_p("p_partkey", "p").alias("file"), F.col("p_brand").alias("module"))


def part_links(spark: SparkSession, d: str) -> DataFrame:
    """Import edges by the parts' keys."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("dst"))
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("dst").alias("src"))
    return a.join(lines, ["l_orderkey", "l_linenumber"]).select("src", "dst").where("src <> dst")


def part_name(key: Column) -> Column:
    return F.concat(F.lit("p"), key.cast("string"))


def part_imports(spark: SparkSession, d: str) -> DataFrame:
    return part_links(spark, d).select(part_name(F.col("src")).alias("src"), part_name(F.col("dst")).alias("dst"))


PART_SQL = """pf AS (SELECT 'p' || p_partkey AS file, p_brand AS module FROM part),
pi AS (SELECT 'p' || a.l_partkey AS src, 'p' || b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey),
pe AS (SELECT DISTINCT src, dst FROM pi)"""


# Customers as symbols of their nation's file; every event's day imports the symbol of its user.

KINDS = {"AUTOMOBILE": "class", "BUILDING": "function", "FURNITURE": "const", "HOUSEHOLD": "interface"}


def customer_symbols(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lit("type")
    for k, v in KINDS.items():
        kind = F.when(F.col("c_mktsegment") == k, v).otherwise(kind)
    return table(spark, d, "customer").select(_p("c_custkey", "c").alias("symbol_id"), _p("c_nationkey", "n").alias("file"), F.col("c_name").alias("name"), kind.alias("kind"), (F.col("c_acctbal") >= 0).alias("exported"))


def day_imports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("src"), _p("user_id", "c").alias("dst")).distinct()


CUSTOMER_SQL = f"""cs AS (SELECT 'c' || c_custkey AS symbol_id, 'n' || c_nationkey AS file, c_name AS name, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'type' END AS kind, c_acctbal >= 0 AS exported FROM customer),
di AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS src, 'c' || user_id AS dst FROM events)"""


# Documents and pages as source files.


def sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("file"), F.col("text").alias("content"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("content"))
    return docs.unionByName(pages)


SOURCES_SQL = """sf AS (SELECT 'doc/' || doc_id || '.js' AS file, text AS content FROM documents UNION ALL SELECT 'page/' || page_id || '.html', html FROM pages),
sl AS (SELECT file, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM sf)"""


# Conversations as classes, their turns as members.


def turn_symbols(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.role", "x.text")
    lines = F.size(F.split("text", "\n", -1))
    file = F.concat(F.lit("conv/"), (F.floor(F.col("conv_id") / 10)).cast("string"))
    members = t.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("symbol_id"), file.alias("file"), _p("conv_id", "k").alias("parent_id"),
        F.when(F.col("role") == "user", "method").otherwise("field").alias("kind"), F.lit("public").alias("visibility"), F.lit(None).cast("boolean").alias("exported"),
        (F.col("turn") * 1000).cast("long").alias("start_line"), (F.col("turn") * 1000 + lines - 1).cast("long").alias("end_line"), F.concat(F.lit("f("), "text", F.lit(")")).alias("signature"),
    )
    classes = t.groupBy("conv_id").agg(F.max("turn").alias("m")).select(
        _p("conv_id", "k").alias("symbol_id"), file.alias("file"), F.lit(None).cast("string").alias("parent_id"), F.lit("class").alias("kind"), F.lit("public").alias("visibility"), F.lit(True).alias("exported"),
        F.lit(0).cast("long").alias("start_line"), (F.col("m") * 1000 + 999).cast("long").alias("end_line"), F.lit(None).cast("string").alias("signature"),
    )
    return members.unionByName(classes)


TURN_SQL = """tt AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS x FROM conversations GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, x.role AS role, x.text AS text FROM tt),
ts AS (SELECT 't' || conv_id || '.' || turn AS symbol_id, 'conv/' || (conv_id // 10) AS file, 'k' || conv_id AS parent_id, CASE WHEN role = 'user' THEN 'method' ELSE 'field' END AS kind, 'public' AS visibility, NULL::BOOLEAN AS exported, (turn * 1000)::BIGINT AS start_line, (turn * 1000 + len(string_split(text, chr(10))) - 1)::BIGINT AS end_line, 'f(' || text || ')' AS signature FROM t
 UNION ALL SELECT 'k' || conv_id, 'conv/' || (conv_id // 10), NULL, 'class', 'public', true, 0, (max(turn) * 1000 + 999)::BIGINT, NULL FROM t GROUP BY conv_id)"""
