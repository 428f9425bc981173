"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities, and shard k of the new layout is
the old shard of the same rank.  A flow network sends every byte from its old shard to
a new one: staying costs nothing, moving costs one a byte, through a hub that joins all
old shards to all new ones, so the network has three arcs a shard instead of
their product.  A primal-dual solver finds the flow that moves the fewest bytes; the
amounts that leave a shard are matched with those that others lack in rank order.

A shard's documents fall into blocks by id, as many as its size asks for: BLOCKS for a
new shard of average size, and at least one for MAX_BLOCK bytes.  Blocks, in order, are cut at the
flow's amounts: the first stay, the next go to the first receiver and so on; a block goes
where its middle byte falls, so a cut misses its place by at most half a block.
Only the sizes of shards come to the driver; blocks are added up and placed by a window over each shard.
Shards that lose or get a block are rewritten, one folder each, and others left alone; as many tasks write
a shard as its size asks for.

Defined cases.  A document counts its text's UTF-8 bytes and one more, so a null or empty
text counts 1.  A null shard name is a shard of its own, ranked first.  Ids may be of any type: integers go to blocks
by their remainder, others by a checksum, and null ids by that of the text.  Repeated rows are moved together and all kept, though
several tasks may write them.  More new shards than old: the
rest start empty; fewer: the surplus old shards are emptied.  No documents: no shards, an empty result.
Columns of the input called like those that are added, or like the __ ones used within, are replaced.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.llm._text import named, without
from quarrystone.session import materialize, scratch_path

BLOCKS = 64
MAX_BLOCK = 32 << 20
NEW_SHARDS = 24
#: Bytes of text that one task writes to a new shard.
TASK_BYTES = 64 << 20
#: A block table up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


class Network:
    """A flow network with integer capacities and non-negative costs."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(n)]

    def add(self, u: int, v: int, capacity: int, cost: int) -> int:
        self.arcs[u].append(len(self.to))
        self.to += [v, u]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        self.arcs[v].append(len(self.to) - 1)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def solve(self, source: int, sink: int) -> tuple[int, int]:
        """(amount, cost) of a maximum flow of least cost: shortest distances, then blocking flows along them."""
        n = len(self.arcs)
        potential, amount, total = [0] * n, 0, 0
        while True:
            far = [float("inf")] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for a in self.arcs[u]:
                    v = self.to[a]
                    if self.left[a] and (e := d + self.cost[a] + potential[u] - potential[v]) < far[v]:
                        far[v] = e
                        heapq.heappush(heap, (e, v))
            if far[sink] == float("inf"):
                return amount, total
            for u in range(n):
                potential[u] += min(far[u], far[sink])
            while pushed := self._block(source, sink, potential):
                amount += pushed
                total += pushed * (potential[sink] - potential[source])

    def _block(self, source: int, sink: int, potential: list[int]) -> int:
        """A blocking flow over arcs of no reduced cost."""
        level = [-1] * len(self.arcs)
        level[source] = 0
        queue = deque([source])
        tight = lambda u, a: self.left[a] and self.cost[a] + potential[u] == potential[self.to[a]]
        while queue:
            u = queue.popleft()
            for a in self.arcs[u]:
                if level[self.to[a]] < 0 and tight(u, a):
                    level[self.to[a]] = level[u] + 1
                    queue.append(self.to[a])
        if level[sink] < 0:
            return 0
        at, pushed, path, u = [0] * len(self.arcs), 0, [], source
        while True:
            if u == sink:
                amount = min(self.left[a] for a in path)
                for a in path:
                    self.left[a] -= amount
                    self.left[a ^ 1] += amount
                pushed += amount
                cut = next(k for k, a in enumerate(path) if not self.left[a])
                u = self.to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[u] < len(self.arcs[u]):
                a = self.arcs[u][at[u]]
                if level[self.to[a]] == level[u] + 1 and tight(u, a):
                    break
                at[u] += 1
            if at[u] < len(self.arcs[u]):
                path.append(a)
                u = self.to[a]
            elif path:
                u = self.to[path.pop() ^ 1]
                at[u] += 1
            else:
                return pushed


def transfers(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[tuple[int, int, int]], int]:
    """(bytes that stay in each old shard, (from, to, bytes) of the moves, bytes moved)."""
    n, m = len(sizes), len(capacities)
    if sum(capacities) < sum(sizes):
        raise ValueError("the capacities hold less than the shards")
    source, sink, hub = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    stay, leave, get = {}, [], []
    for i, s in enumerate(sizes):
        net.add(source, i, s, 0)
        if i < m:
            stay[i] = net.add(i, n + i, s, 0)
        leave.append(net.add(i, hub, s, 1))
    for j, c in enumerate(capacities):
        net.add(n + j, sink, c, 0)
        get.append(net.add(hub, n + j, c, 0))
    _, moved = net.solve(source, sink)
    moves, j, room = [], 0, [net.flow(a) for a in get]
    for i in range(n):
        rest = net.flow(leave[i])
        while rest:
            while not room[j]:
                j += 1
            part = min(rest, room[j])
            moves.append((i, j, part))
            rest -= part
            room[j] -= part
    return [net.flow(stay[i]) if i in stay else 0 for i in range(n)], moves, moved


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total``, as equal as whole bytes allow."""
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


@dataclass(frozen=True)
class Plan:
    """Old shards by rank, the cuts of each, and what that costs.

    ``cuts``: for each old shard, (bytes up to which, new shard).  ``moved_bytes``: what the blocks that
    move hold; ``least_bytes``: the flow's cost.  ``affected``: the shards that lose or get a block.
    """

    shards: list[str | None]
    sizes: list[int]
    cuts: list[list[tuple[int, int]]]
    block_bytes: int
    least_bytes: int
    new_shards: int
    moved_bytes: int = 0
    affected: frozenset[int] = frozenset()


def plan(sizes: dict[str | None, int], capacities: list[int] | None = None, shards: int = NEW_SHARDS) -> Plan:
    """Solve the transfers for the shards' sizes."""
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    held = [sizes[s] for s in names]
    if capacities is None:
        capacities = even_capacities(sum(held), shards)
    stay, moves, least = transfers(held, capacities)
    cuts: list[list[tuple[int, int]]] = [[(stay[i], i)] if stay[i] else [] for i in range(len(names))]
    for i, j, amount in moves:
        cuts[i].append(((cuts[i][-1][0] if cuts[i] else 0) + amount, j))
    block = max(1, min(MAX_BLOCK, sum(held) // (max(1, len(capacities)) * BLOCKS)))
    return Plan(names, held, cuts, block, least, max(1, len(capacities)))


def _key(name: Column) -> Column:
    """A shard's name as a join key that isn't null."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def _sized(docs: DataFrame, shard_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__shard": _key(named(shard_col)), "__bytes": F.coalesce(F.octet_length(named(text_col)), F.lit(0)).cast("long") + 1})


def shard_sizes(docs: DataFrame, shard_col: str = "source", text_col: str = "text") -> dict[str | None, int]:
    """Bytes of each shard: one row a shard."""
    rows = _sized(docs, shard_col, text_col).groupBy("__shard").agg(F.sum("__bytes").alias("n"))
    return {r["__shard"][1:] if r["__shard"] else None: r["n"] for r in rows.toLocalIterator()}


def _block(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The block of a row among ``__blocks``."""
    other = lambda c: F.crc32(c.cast("string").cast("binary"))
    number = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else other(named(id_col))
    return F.pmod(F.coalesce(number, other(named(text_col)), F.lit(0)), F.col("__blocks"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(blocks: DataFrame, found: Plan) -> DataFrame:
    """(__shard, __at, new_shard, moved, size): where each block of (__shard, __at, size) goes."""
    spark = blocks.sparkSession
    rows = [(_name(found.shards[i]), 2 * (own[k - 1][0] if k else 0), 2 * upto, j, i != j) for i, own in enumerate(found.cuts) for k, (upto, j) in enumerate(own)]
    cuts = _small(spark.createDataFrame(rows, "__shard string, __from long, __to long, new_shard int, moved boolean"), len(rows))
    before = Window.partitionBy("__shard").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    middle = 2 * F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size")
    return blocks.withColumn("__middle", middle).join(cuts, "__shard").where("__middle >= __from and __middle < __to").select("__shard", "__at", "new_shard", "moved", "size")


def _name(s: str | None) -> str:
    return "" if s is None else "=" + s


def reshard(docs: DataFrame, capacities: list[int] | None = None, shards: int = NEW_SHARDS, id_col: str = "doc_id", shard_col: str = "source", text_col: str = "text") -> tuple[DataFrame, Plan, str]:
    """The documents in their new layout, with columns new_shard, n_bytes and moved; the plan; and the folder of the rewritten shards.

    Affected shards are read back from the files written for them.
    """
    spark = docs.sparkSession
    docs = without(docs, "new_shard", "n_bytes", "moved", "__bytes", "__shard", "__at", "__blocks", "__affected", "__folder")
    found = plan(shard_sizes(docs, shard_col, text_col), capacities, shards)
    count = [(_name(s), -(-n // found.block_bytes)) for s, n in zip(found.shards, found.sizes, strict=True)]
    blocks = _small(spark.createDataFrame(count, "__shard string, __blocks long"), len(count))
    sized = _sized(docs, shard_col, text_col).join(blocks, "__shard").withColumn("__at", _block(docs, id_col, text_col))
    goal, _ = materialize(targets(sized.groupBy("__shard", "__at").agg(F.sum("__bytes").alias("size")), found), "blocks")
    rank = {_name(s): i for i, s in enumerate(found.shards)}
    moves = goal.groupBy("__shard", "new_shard", "moved").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    affected = frozenset(k for r in moves if r["moved"] for k in (rank[r["__shard"]], r["new_shard"]))
    found = replace(found, moved_bytes=sum(r["size"] for r in moves if r["moved"]), affected=affected)
    table = _small(goal.select("__shard", "__at", "new_shard", "moved", F.col("new_shard").isin(*affected).alias("__affected") if affected else F.lit(False).alias("__affected")), sum(r["n"] for r in moves))
    placed = sized.join(table, ["__shard", "__at"]).withColumnRenamed("__bytes", "n_bytes").drop("__shard", "__at", "__blocks")
    path = scratch_path(spark, "shards")
    layout = placed.where("__affected").drop("__affected").withColumn("__folder", F.col("new_shard"))
    tasks = max(4, -(-sum(found.sizes) // (found.new_shards * TASK_BYTES)))
    # the partition a row comes from spreads even rows that are all alike
    salt = F.pmod(F.xxhash64(named(id_col), named(text_col)) + F.spark_partition_id(), F.lit(tasks))
    layout.repartition(found.new_shards * tasks, "new_shard", salt).write.partitionBy("__folder").parquet(path)
    final = [named(c) for c in (*docs.columns, "new_shard", "n_bytes", "moved")]
    again = spark.read.schema(layout.schema).parquet(path).select(*final)
    left = placed.where("not __affected").select(*final)
    return again.unionByName(left), found, path
