"""Session set-up and the shared scratch folder that iterative jobs write to.

A job that loops (connected components, closures) must cut its lineage, and the
cut has to survive the loss of an executor.  ``materialize`` therefore writes a
Parquet table to the folder every executor shares and reads it back; nothing is
kept on one machine only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", name: str = "quarrystone", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (tests, bench)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only if that is unset in local mode.

    There driver and executors share one disk; elsewhere the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    holder = spark.sparkContext
    if not holder.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = getattr(holder, "_quarrystone_scratch", None)
    if found is None:
        found = tempfile.mkdtemp(prefix="quarrystone-")
        holder._quarrystone_scratch = found
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return "file://" + found


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are deleted when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; return the reread table and its path."""
    path = scratch_path(df.sparkSession, label)
    with cleaning(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Python functions are pickled by reference, so workers must be able to import it.
    """
    context = spark.sparkContext
    if getattr(context, "_quarrystone_shipped", False):
        return
    home = Path(__file__).resolve().parent
    where = tempfile.mkdtemp(prefix="quarrystone-code-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    bundle = f"{where}/quarrystone.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(bundle)
    context._quarrystone_shipped = True
