"""Changed files and earlier contents from a git working tree, read on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from quarrystone.functions.text import content_key
from quarrystone.sources.languages import language_of


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def changed(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(file, status): A, M or D against ``base``; a rename counts as modified under its new name, an untracked file as added."""
    rows = []
    for line in _git(root, "diff", "--name-status", "-M", base).splitlines():
        status, *paths = line.split("\t")
        rows.append((paths[-1], "M" if status[0] in "RC" else status[0]))
    rows += [(f, "A") for f in _git(root, *"ls-files --others --exclude-standard".split()).splitlines()]
    return spark.createDataFrame(rows, "file string, status string")


def contents_at(spark: SparkSession, root: str, files: list[str], base: str = "HEAD") -> DataFrame:
    """(file, content, language, hash) of ``files`` as of ``base``; files it lacks are left out."""
    rows = []
    for f in files:
        try:
            rows.append((f, _git(root, "show", f"{base}:{f}")))
        except subprocess.CalledProcessError:
            continue
    df = spark.createDataFrame(rows, "file string, content string")
    return df.withColumn("language", language_of(df["file"])).withColumn("hash", content_key(df["content"]))


def churn(spark: SparkSession, root: str) -> DataFrame:
    """(file, churn): how many commits touched each file."""
    names = [x for x in _git(root, "log", "--pretty=format:", "--name-only").splitlines() if x]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    return df.groupBy("file").count().withColumnRenamed("count", "churn")
