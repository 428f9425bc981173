"""Text functions as Spark columns: identifier splitting, stemming, ratings, paths.

All are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_words(name: Column) -> Column:
    """The lower-case words of an identifier: getHTTPServerByID2 -> get, http, server, by, id, 2."""
    small, capital, digit = r"\p{Lower}", r"\p{Upper}", r"\p{Digit}"
    places = (f"(?<=[{small}{digit}])(?={capital})", f"(?<={capital})(?={capital}{small})", f"(?<=[{small}{capital}])(?={digit})", f"(?<={digit})(?=[{small}{capital}])")
    s = F.regexp_replace(name, "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(s, "|".join(places), " ")), " "), lambda x: x != "")


def _identifier_sql() -> str:
    x = "regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')"
    small, capital, digit = "[:lower:]", "[:upper:]", "[:digit:]"
    for before, after in ((f"[{small}{digit}]", f"[{capital}]"), (f"[{capital}]+", f"[{capital}][{small}]"), (f"[{small}{capital}]", f"[{digit}]"), (f"[{digit}]", f"[{small}{capital}]")):
        x = f"regexp_replace({x}, '({before})({after})', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower({x}), ' '), lambda x: x <> '')"


#: The same in SQL, for format() with the expression.
IDENTIFIER_SQL = _identifier_sql()


def _undoubled(s: Column) -> Column:
    n = F.length(s)
    double = (n >= 2) & (F.substring(s, -1, 1) == F.substring(s, -2, 1)) & F.substring(s, -1, 1).rlike("[a-z]")
    return F.when(double, F.left(s, n - 1)).otherwise(s)


def stem(w: Column) -> Column:
    """A light English stem: entries -> entry, users -> user, hashing -> hash, running -> run."""
    n = F.length(w)
    cut = lambda k: F.left(w, n - k)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ing") & (n > 4), _undoubled(cut(3)))
        .when(w.endswith("ed") & (n > 4), _undoubled(cut(2)))
        .when(w.endswith("es") & (n > 3), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), cut(1))
        .otherwise(w)
    )


def stem_sql(w: str) -> str:
    def undouble(x: str) -> str:
        return f"CASE WHEN length({x}) >= 2 AND right({x}, 1) = left(right({x}, 2), 1) AND regexp_matches(right({x}, 1), '[a-z]') THEN left({x}, length({x}) - 1) ELSE {x} END"

    cut = lambda k: f"left({w}, length({w}) - {k})"
    return (
        f"CASE WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN {cut(3)} || 'y' WHEN ends_with({w}, 'ing') AND length({w}) > 4 THEN {undouble(cut(3))} "
        f"WHEN ends_with({w}, 'ed') AND length({w}) > 4 THEN {undouble(cut(2))} WHEN ends_with({w}, 'es') AND length({w}) > 3 THEN {cut(2)} "
        f"WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND length({w}) > 3 THEN {cut(1)} ELSE {w} END"
    )


def rounded(x: Column, places: int) -> Column:
    """Rounded as binary arithmetic does it, halves up: floor(x * 10^p + 0.5) / 10^p."""
    return F.floor(x * F.lit(float(10**places)) + F.lit(0.5)).cast("double") / F.lit(float(10**places))


def rounded_sql(x: str, places: int) -> str:
    return f"(floor(({x})::DOUBLE * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE)"


def rating(complexity: Column) -> Column:
    return F.when(complexity <= 5, "low").when(complexity <= 10, "moderate").when(complexity <= 20, "high").otherwise("very-high")


RATING_SQL = "CASE WHEN {0} <= 5 THEN 'low' WHEN {0} <= 10 THEN 'moderate' WHEN {0} <= 20 THEN 'high' ELSE 'very-high' END"


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def dirname(path: Column) -> Column:
    """The folder of a path, '.' for a root-level file."""
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def content_key(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a text."""
    return F.left(F.sha2(content, 256), F.lit(16))


def size_bucket(lines: Column) -> Column:
    return F.when(lines <= 5, "xs").when(lines <= 20, "sm").when(lines <= 60, "md").otherwise("lg")


SIZE_SQL = "CASE WHEN {0} <= 5 THEN 'xs' WHEN {0} <= 20 THEN 'sm' WHEN {0} <= 60 THEN 'md' ELSE 'lg' END"
