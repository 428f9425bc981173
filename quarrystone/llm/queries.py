"""One query per corpus operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import bpe, decontaminate, html_text, katz, order_minhash, pii, quality, reshard, simhash, urls
from quarrystone.llm.oracles import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, decision and reason of every page's address."""
    return urls.filter_urls(_table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.BLOCKED), urls.rule_table(spark, urls.ALLOWED))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", "decoded")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document that the ranking keeps."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select("doc_id", "score")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the trigram model of the other folds, and the mean over its tokens."""
    scored = katz.cross_scores(_table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "n_tokens", F.round("logprob", 4).alias("logprob"), F.round(F.col("logprob") / F.col("n_tokens"), 4).alias("mean_logprob"))


def op5_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's old and new shard, read from the rewritten layout."""
    layout, _, _ = reshard.reshard(_table(spark, sf_dir, "documents"))
    return layout.select("doc_id", F.col("source").alias("old_shard"), "new_shard", "n_bytes", "moved")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature of every document."""
    return order_minhash.fingerprint(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near-duplicate and the document that stands for its group."""
    return simhash.duplicates(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "duplicate_of").distinct()


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's own text, without the lines it shares with its neighbour."""
    return html_text.page_differences(_table(spark, sf_dir, "pages")).drop("url")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.apply(docs, count_col="n_replaced")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_bpe, op3_quality, op4_katz, op5_reshard, op6_order_minhash, op7_decontaminate, op8_simhash, op9_html, op10_pii)}
ORACLES: dict[str, str] = {k: v for k, v in SQL.items() if k in QUERIES}
