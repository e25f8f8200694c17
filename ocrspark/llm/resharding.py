"""Resharding by minimum-cost flow: new shards of equal bytes with the fewest bytes moved.

Documents lie in old shards and, within them, in blocks by hash. Only the table of blocks, whose
size is a parameter, reaches the driver. There a flow from old shards to the capacities of the
new ones is solved in which a byte that stays costs nothing and a byte that moves costs one;
blocks are then chosen to carry the flows. Rows follow their block. Every shard is written anew:
keeping the files of shards that win or lose no block (``Plan.affected``) is not built.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ocrspark.llm.common import quoted, session, unused

#: Blocks per old shard: with more of them the new sizes come closer to each other.
BLOCKS = 1024
#: Parts in which a new shard is numbered and written.
PARTS = 64


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge ``(from, to, capacity, cost)`` of a maximal flow of least cost.

    Shortest augmenting paths, found with a queue as residual costs may be negative.
    """
    to, room, cost, at = [], [], [], defaultdict(list)
    for a, b, capacity, price in edges:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            at[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
    while True:
        dist, via = {source: 0}, {}
        queue, queued = deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in at[x]:
                y = to[e]
                if room[e] > 0 and dist[x] + cost[e] < dist.get(y, float("inf")):
                    dist[y], via[y] = dist[x] + cost[e], e
                    if y not in queued:
                        queue.append(y)
                        queued.add(y)
        if sink not in dist:
            return [room[2 * k + 1] for k in range(len(edges))]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def transfers(old: dict[int, int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, the fewest of them between different shards."""
    olds = sorted(old)
    source, first_new = 0, 1 + len(olds)
    sink = first_new + len(capacity)
    edges = [(source, 1 + k, old[o], 0) for k, o in enumerate(olds)]
    edges += [(first_new + t, sink, c, 0) for t, c in enumerate(capacity)]
    pairs = [(o, t) for o in olds for t in range(len(capacity))]
    edges += [(1 + olds.index(o), first_new + t, old[o], int(o != t)) for o, t in pairs]
    flow = min_cost_flow(sink + 1, edges, source, sink)[-len(pairs):] if pairs else []
    return {p: f for p, f in zip(pairs, flow) if f}


@dataclass
class Plan:
    """New shard of every block, and the bytes that change their shard."""

    shard: dict[tuple[int, int], int]
    moved: int
    affected: set[int]


def plan(blocks: list[tuple[int, int, int]], shards: int) -> Plan:
    """Assign blocks ``(old shard, block, bytes)`` to new shards of equal capacity."""
    total = sum(b for _, _, b in blocks)
    capacity = [total // shards + (t < total % shards) for t in range(shards)]
    old: dict[int, int] = defaultdict(int)
    for o, _, size in blocks:
        old[o] += size
    left = defaultdict(dict)
    for (o, t), f in transfers(old, capacity).items():
        left[o][t] = f
    placed, fill = {}, [0] * shards
    for o, b, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        room = left[o] or {o % shards: 0}
        t = max(room, key=lambda t: (room[t], -t))
        room[t] -= size
        placed[o, b] = t
        fill[t] += size
    _level(placed, fill, {(o, b): size for o, b, size in blocks})
    sizes = {(o, b): size for o, b, size in blocks}
    moves = [(o, t, sizes[o, b]) for (o, b), t in placed.items() if t != o]
    return Plan(placed, sum(m[2] for m in moves), {x for o, t, _ in moves for x in (o, t)})


def _level(placed: dict, fill: list[int], sizes: dict) -> None:
    """Even out what whole blocks leave: move the block nearest to half the gap while that helps."""
    members = defaultdict(list)
    for key, t in placed.items():
        if sizes[key]:
            members[t].append(key)
    for _ in range(20 * len(fill)):
        high, low = max(range(len(fill)), key=fill.__getitem__), min(range(len(fill)), key=fill.__getitem__)
        gap = fill[high] - fill[low]
        key = min(members[high], key=lambda k: (abs(2 * sizes[k] - gap), k), default=None)
        if key is None or sizes[key] >= gap:
            return
        members[high].remove(key)
        members[low].append(key)
        placed[key] = low
        fill[high] -= sizes[key]
        fill[low] += sizes[key]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def reshard(
    df: DataFrame, path: str, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text",
    blocks: int = BLOCKS,
) -> DataFrame:
    """Write ``df`` under ``path`` in ``shards`` folders ``shard=N`` of equal bytes, and read it back.

    ``old_shard`` tells where a row lies now. The result has the columns of ``df`` with ``shard`` and
    ``slot``, the place of a row in its shard from 0 without gaps, in the order of parts, ids and
    checksums.

    - A null text has no bytes; every row counts 8 bytes besides. Sizes differ by about one block, or
      by one row where rows are larger than that. Rows equal in id and checksum are one block of
      each old shard and are not split, so many of them can make a shard larger than the others.
    - Rows with a null id and repeated rows are rows like others; which of two equal rows comes
      first is not defined, as they cannot be told apart.
    - Columns named ``shard`` or ``slot`` are replaced, others pass through. An empty table is
      written as an empty table.
    """
    spark = session(df.sparkSession)
    df = df.drop("shard", "slot")
    text, key = F.col(quoted(text_col)), F.col(quoted(id_col))
    own, at, crc, size, part_col, base_col = unused(df, "_old", "_block", "_crc", "_size", "_part", "_base")
    sums = {own: old_shard.cast("int"), crc: F.coalesce(F.crc32(text.cast("binary")), F.lit(0)), size: size_of(text)}
    keyed = df.withColumns(sums).withColumn(at, F.pmod(F.xxhash64(key, crc, F.lit(3)), F.lit(blocks)).cast("int"))
    found = keyed.groupBy(F.col(own).alias("old"), F.col(at).alias("block")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()
    chosen = plan([(r.old, r.block, r.bytes) for r in found], shards)
    counts: dict[tuple[int, int], int] = defaultdict(int)
    for r in found:
        counts[chosen.shard[r.old, r.block], r.block % PARTS] += r.n
    base, total = {}, defaultdict(int)
    for shard, part in sorted(counts):
        base[shard, part] = total[shard]
        total[shard] += counts[shard, part]
    rows = [
        (o, b, t, b % PARTS, base[t, b % PARTS]) for (o, b), t in chosen.shard.items()
    ]
    placed = spark.createDataFrame(rows, "old int, block int, shard int, part int, base long").toDF(own, at, "shard", part_col, base_col)
    # a row per block: their number is a parameter times the old shards
    met = keyed.join(F.broadcast(placed), [own, at])
    order = Window.partitionBy("shard", part_col).orderBy(key, crc)
    slot = F.col(base_col) + F.row_number().over(order) - 1
    numbered = met.withColumn("slot", slot).select(*[quoted(c) for c in df.columns], "shard", "slot")
    numbered.write.partitionBy("shard").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path).select(*[quoted(c) for c in numbered.columns])
