"""Reading source trees: one row a file, filtered before any content is parsed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import content_key
from quarrystone.sources.languages import IGNORED, LANGUAGES, MAX_BYTES, language_of, scannable


def guard(path: str, roots: list[str]) -> str:
    """The resolved path if it lies within one of ``roots``, else an error."""
    p = Path(path).resolve()
    for r in roots:
        root = Path(r).resolve()
        if p == root or root in p.parents:
            return str(p)
    raise PermissionError(f"{path} lies outside the allowed roots")


def source_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES, roots: list[str] | None = None) -> DataFrame:
    """(file, language, size, content, hash) of every supported file under ``folder``; paths are relative to it.

    Extension, folder and size are tested on the listing's columns, so skipped files' contents
    aren't read.  A file that isn't UTF-8 is decoded with replacement signs.  Spark's listing
    passes over names that start with an underscore; on a mounted folder they are added, read
    by the executors, while in an object store they are left out.
    """
    base = guard(folder, roots) if roots else (folder if "://" in folder else str(Path(folder).resolve()))
    prefix = base.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # Listed paths carry a scheme, whose number of slashes varies.
    bare = prefix.split("://", 1)[-1].lstrip("/")
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "")
    rows = raw.withColumn("file", F.substr(full, F.lit(len(bare) + 1))).select("file", "length", "content")
    if "://" not in base:
        rows = rows.unionByName(_underscored(spark, base))
    rows = rows.where(scannable(F.col("file")) & (F.col("length") <= max_bytes)).withColumn("language", language_of(F.col("file"))).where("language is not null")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("file", "language", F.col("length").alias("size"), text.alias("content")).withColumn("hash", content_key(F.col("content")))


def named_files(spark: SparkSession, folder: str, names: tuple[str, ...], roots: list[str] | None = None) -> DataFrame:
    """(file, content) of the files under ``folder`` that bear one of ``names``, such as manifests; paths are relative to it."""
    base = guard(folder, roots) if roots else (folder if "://" in folder else str(Path(folder).resolve()))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(base)
    bare = (base.rstrip("/") + "/").split("://", 1)[-1].lstrip("/")
    rows = raw.select(F.substr(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), F.lit(len(bare) + 1)).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.where(scannable(F.col("file")))


def _underscored(spark: SparkSession, base: str) -> DataFrame:
    """(file, length, content) of the files below a mounted folder whose names, or a folder's, start with an underscore."""
    names = []
    for folder, below, files in os.walk(base):
        below[:] = [d for d in below if not d.startswith(".") and d not in IGNORED]
        at = os.path.relpath(folder, base)
        hidden = any(x.startswith("_") for x in at.split(os.sep))
        names += [os.path.normpath(os.path.join(at, f)).replace(os.sep, "/") for f in files if (hidden or f.startswith("_")) and f.rpartition(".")[2].lower() in LANGUAGES]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [Path(base, f).read_bytes() for f in b["file"]]
            yield pd.DataFrame({"file": b["file"], "length": [len(c) for c in content], "content": content})

    return spark.createDataFrame([(n,) for n in names], "file string").mapInPandas(read, "file string, length long, content binary")
