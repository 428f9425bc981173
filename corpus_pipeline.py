"""The corpus pipeline: documents in, filtered, cleaned and tokenised documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs.

Defined cases, for the pipeline and each of its stages.  A null or empty text is scored like an
empty one by the ranking, is never a duplicate, overlaps no benchmark item, holds no personal data and has
null or no tokens.  Rows without an id go through all stages: they are never duplicates.  Texts are read
whole, whatever their length.  Equal scores are treated alike; of a group of near-duplicates the least
id stays, and of rows that repeat id and text one.  Rows that share an id but not a text are
documents of their own.  Extra columns pass through under any name, but the last stage
replaces columns called tokens and decoded.  Labels and items that are null, or of unknown documents, count for
nothing; without labels of both sides every document is kept.  An empty table gives an empty result.
Pseudonyms are linked within a session (see ``pii.session_key``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import bpe, decontaminate, pii, quality, simhash
from quarrystone.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the preference ranking, learned from the labels, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the least id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that overlap no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same length and format."""
    return pii.apply(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids and the text they decode to."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe encoding and decoding", tokens_stage),
]

#: The ranking's fit, the fingerprints and the keyed permutations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
