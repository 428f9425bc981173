"""Closures over the edges of all lines, against a breadth-first search."""

import datetime
import random

from quarrystone.operators import components as C
from quarrystone.operators import delta as D
from quarrystone.operators import graph as G
from quarrystone.plans import graph_plans, quality_plans

LINES = [(1, 1, 9.0), (1, 2, 1.0), (2, 2, 8.0), (2, 3, 2.0), (3, 3, 7.0), (4, 4, 5.0)]


def _reach(seed):
    edges = {("s%d" % s, "p%d" % p) for s, p, _ in LINES}
    edges |= {(b, a) for a, b in edges}
    seen, todo = {seed}, [seed]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if b == at and a not in seen:
                seen.add(a)
                todo.append(a)
    return {(seed, f) for f in seen - {seed}}


def _tables(spark, d):
    spark.createDataFrame(LINES, "l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    day = datetime.date
    orders = [(1, "1-URGENT", day(1996, 5, 1)), (4, "5-LOW", day(1996, 5, 1)), (2, "5-LOW", day(1997, 5, 1))]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_orderdate date").write.parquet(f"{d}/orders.parquet")
    return str(d)


def test_closures_follow_every_line(spark, tmp_path):
    d = _tables(spark, tmp_path)
    got = lambda f: sorted(tuple(r) for r in f(spark, d).select("seed", "file").collect())
    assert got(graph_plans.change_impact) == sorted(_reach("s1"))
    assert got(quality_plans.blast_radius) == sorted(_reach("s1") | _reach("s4"))


def test_blast_radius_does_not_write_pairs_in_rounds(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs of seed and file are closed in rounds")

    monkeypatch.setattr(D, "impact", refuse)
    monkeypatch.setattr(G, "impact", refuse)
    got = sorted(tuple(r) for r in quality_plans.blast_radius(spark, _tables(spark, tmp_path)).collect())
    assert got == sorted(_reach("s1") | _reach("s4"))


def test_change_impact_does_not_copy_or_sort_the_edges(spark, tmp_path, monkeypatch):
    written, real = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: (written.append(label), real(df, label))[1])
    df = graph_plans.change_impact(spark, _tables(spark, tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == sorted(_reach("s1")) and set(written) == {"impact"}
    assert "HashAggregate" not in df._jdf.queryExecution().toString()


def test_linked_against_a_search(spark, monkeypatch):
    monkeypatch.setattr(C, "FOREST_EDGES", 7)
    pick = random.Random(3)
    pairs = [(pick.randrange(90), pick.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 3), (4, None)]
    groups = {k: {k} for p in pairs if None not in p for k in p}
    for a, b in pairs:
        if None not in (a, b) and groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for k in groups[b]:
                groups[k] = groups[a]
    edges, seeds = spark.createDataFrame(pairs, "src long, dst long"), [5, 7, 210, 1000]
    got = G.linked(edges, spark.createDataFrame([(k, k) for k in seeds + [7]], "seed long, file long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((s, k) for s in seeds for k in groups.get(s, ()) if k != s)
