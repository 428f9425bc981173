import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm import reshard as R

from .common import awkward, empty


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=6), st.lists(st.integers(0, 30), min_size=1, max_size=6))
def test_fewest_bytes_move(sizes, capacities):
    if sum(capacities) < sum(sizes):
        with pytest.raises(ValueError):
            R.transfers(sizes, capacities)
        return
    stay, moves, moved = R.transfers(sizes, capacities)
    # what can stay is bounded by each pair of sizes, and a hub reaches every capacity
    assert moved == sum(sizes) - sum(min(a, b) for a, b in itertools.zip_longest(sizes, capacities, fillvalue=0))
    assert moved == sum(n for _, _, n in moves)
    for i, s in enumerate(sizes):
        assert stay[i] + sum(n for a, _, n in moves if a == i) == s
    for j, c in enumerate(capacities):
        assert (stay[j] if j < len(stay) else 0) + sum(n for _, b, n in moves if b == j) <= c


def test_small_network_by_enumeration():
    net = R.Network(4)
    arcs = [(0, 1, 2, 1), (0, 2, 2, 3), (1, 3, 1, 1), (2, 3, 3, 1), (1, 2, 2, 0)]
    for a in arcs:
        net.add(*a)
    best = None
    for f in itertools.product(*(range(c + 1) for _, _, c, _ in arcs)):
        into = lambda v: sum(x for x, a in zip(f, arcs, strict=True) if a[1] == v) - sum(x for x, a in zip(f, arcs, strict=True) if a[0] == v)  # noqa: E731, B023
        if into(1) == into(2) == 0:
            best = min(best or (0, 0), (-into(3), sum(x * a[3] for x, a in zip(f, arcs, strict=True))))
    amount, cost = net.solve(0, 3)
    assert (-amount, cost) == best


def test_layout_holds_every_row_within_a_block_of_capacity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    layout, plan, path = R.reshard(docs, shards=7)
    got = layout.toPandas()
    assert sorted(got["doc_id"]) == sorted(docs.toPandas()["doc_id"])
    assert sorted(got["text"]) == sorted(docs.toPandas()["text"])
    size = got.groupby("new_shard")["n_bytes"].sum()
    sizes = dict(zip(plan.shards, plan.sizes, strict=True))
    count = {s: -(-n // plan.block_bytes) for s, n in sizes.items()}
    block = max(g["n_bytes"].sum() for _, g in got.groupby([got["source"], [i % count[s] for i, s in zip(got["doc_id"], got["source"], strict=True)]]))
    # what the flow sends to each shard, and how many runs of blocks that is
    sent, runs = [0] * 7, [0] * 7
    for own in plan.cuts:
        done = 0
        for upto, j in own:
            sent[j] += upto - done
            runs[j] += 1
            done = upto
    assert sent == R.even_capacities(sum(plan.sizes), 7)
    assert all(abs(size[j] - sent[j]) <= block * runs[j] for j in range(7))
    assert got[got["moved"]]["n_bytes"].sum() == plan.moved_bytes
    assert abs(plan.moved_bytes - plan.least_bytes) <= block / 2 * len(plan.shards)
    assert R.shard_sizes(docs) == sizes


def _brute(rows, shards):
    """Where every row goes, block by block, in plain loops."""
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").encode()) + 1
    found = R.plan(size, shards=shards)
    out = {}
    for i, s in enumerate(found.shards):
        k = -(-size[s] // found.block_bytes)
        blocks = {}
        for n, (d, shard, t) in enumerate(rows):
            if shard == s:
                blocks.setdefault(d % k, []).append((n, len((t or "").encode()) + 1))
        done = 0
        for b in sorted(blocks):
            own = sum(x for _, x in blocks[b])
            j = next(j for upto, j in found.cuts[i] if 2 * done + own < 2 * upto)
            done += own
            out |= {n: (j, j != i) for n, _ in blocks[b]}
    return out


def test_against_brute_force(spark):
    rows = [(k * 7, f"s{(k * k) % 5}", "x" * (k * 37 % 211)) for k in range(400)] + [(k, "big", "y" * 150) for k in range(300)]
    want = _brute(rows, 6)
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, source string, text string, n int")
    layout, plan, _ = R.reshard(docs, shards=6)
    assert {r["n"]: (r["new_shard"], r["moved"]) for r in layout.collect()} == want
    assert len({r["new_shard"] for r in layout.where("source = 'big'").collect()}) > 1


def test_ids_of_any_type_and_null_ids(spark):
    rows = [(f"id{k}", "a", "t" * k) for k in range(50)] + [(None, "a", f"{k}") for k in range(50)]
    layout, _, _ = R.reshard(spark.createDataFrame(rows, "doc_id string, source string, text string"), shards=3)
    assert layout.count() == 100 and len({r["new_shard"] for r in layout.where("doc_id is null").collect()}) > 1


def test_awkward_rows(spark):
    docs = awkward(spark)
    layout, plan, _ = R.reshard(docs, shards=3)
    assert layout.columns.count("new_shard") == 1 and layout.count() == 10
    assert plan.shards[0] is None
    assert sorted((r["doc_id"] or 0) for r in layout.collect()) == sorted((r["doc_id"] or 0) for r in docs.collect())
    layout, plan, _ = R.reshard(empty(spark))
    assert layout.count() == 0 and plan.shards == []
