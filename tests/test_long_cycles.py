"""Cycles longer than the enumerated length."""

from pyspark.sql import functions as F

from quarrystone.operators import graph as G
from quarrystone.project import Project

SCHEMA = "src string, dst string"


def _ring(name, n):
    return [(f"{name}{k}", f"{name}{(k + 1) % n}") for k in range(n)]


def test_rings_of_any_length(spark):
    tail = [("z0", "b0"), ("b3", "a0"), ("a1", "a0"), ("c1", "c0")]
    edges = spark.createDataFrame(_ring("a", 2) + _ring("b", 4) + _ring("c", 7) + tail, SCHEMA)
    groups = {}
    for r in G.cycle_groups(edges).collect():
        groups.setdefault(r["component"], set()).add(r["file"])
    assert groups == {f"{x}0": {f"{x}{k}" for k in range(n)} for x, n in (("a", 2), ("b", 4), ("c", 7))}
    assert sorted((r["length"], r["cycle"][:9]) for r in G.all_cycles(edges, 3).collect()) == [(2, "a0 > a1 >"), (2, "c0 > c1 >"), (4, "component"), (7, "component")]
    assert G.all_cycles(spark.createDataFrame([("a", "b"), ("b", "c")], SCHEMA), 3).count() == 0


def test_project_counts_a_ring_of_seven(spark, monkeypatch):
    edges = spark.createDataFrame(_ring("c", 7), SCHEMA)
    monkeypatch.setattr(Project, "file_edges", edges)
    assert [r["length"] for r in Project(spark, files=spark.createDataFrame([], "file string, language string, content string")).cycles().collect()] == [7]


def test_cycles_of_numbers_are_written_from_the_least_name(spark):
    edges = spark.createDataFrame([(9, 10), (10, 9), (2, 10), (10, 30), (30, 2)], "src long, dst long")
    found = G.elementary_cycles(edges, 3, lambda c: F.concat(F.lit("p"), c.cast("string")))
    assert sorted(tuple(r) for r in found.collect()) == [("p10 > p30 > p2 > p10", 3), ("p10 > p9 > p10", 2)]
