"""Which file extensions belong to which language, and which folders are never scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE = {
    "c": "c h",
    "cpp": "cc cpp cxx hh hpp hxx",
    "csharp": "cs",
    "go": "go",
    "java": "java",
    "javascript": "cjs js jsx mjs",
    "kotlin": "kt kts",
    "php": "php",
    "python": "py pyi",
    "ruby": "rake rb",
    "rust": "rs",
    "svelte": "svelte",
    "swift": "swift",
    "tsx": "tsx",
    "typescript": "cts mts ts",
    "vue": "vue",
}
LANGUAGES: dict[str, str] = {e: lang for lang, exts in _TABLE.items() for e in exts.split()}
IGNORED = ("__pycache__", "build", "dist", "node_modules", "out", "vendor", "venv")
MAX_BYTES = 2_000_000


def language_of(path: Column) -> Column:
    """The language of a path; null if its extension is unknown."""
    ext = F.lower(F.regexp_extract(path, r"[.]([A-Za-z]+)$", 1))
    pairs = [F.lit(x) for kv in sorted(LANGUAGES.items()) for x in kv]
    return F.create_map(*pairs)[ext]


def supported(spark: SparkSession) -> DataFrame:
    """(language, extensions)."""
    rows = [(lang, ",".join(sorted("." + e for e in exts.split()))) for lang, exts in sorted(_TABLE.items())]
    return spark.createDataFrame(rows, "language string, extensions string")


def scannable(path: Column) -> Column:
    """False in dot folders and ignored ones."""
    names = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    return ~F.exists(names, lambda n: (n.startswith(".") & (F.length(n) > 1) & (n != "..")) | n.isin(*IGNORED))
