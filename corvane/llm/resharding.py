"""Resharding by minimum-cost flow: near equal bytes in a new number of shards, moving as few bytes as can be.

The old layout is a Parquet folder: its files, by name, are dealt out to the old shards in turn, and a shard is its files' rows
one after the other.  Rows are told apart by file and row number, so repeated rows, equal texts and null ids need no care, and no
key can be hot.

1. Sizes are written once, beside file and row number; all planning reads that narrow table.
2. Rows of over ``1 / FINE`` of a new shard are blocks of their own (fewer than shards * FINE, whatever the input).  They stay
   where they are while their shard has room for them, the largest first; the others go to the emptiest shard.
3. What room is left is a common level of bytes for each shard, its capacity.  A minimum-cost flow from the old shards' other
   bytes to these capacities (staying costs nothing, moving one for each byte, or any costs given) says how many bytes go where.
4. The flows cut each old shard's rows into blocks.  Chunk sums place a cut in one chunk of a file, running sums in that chunk
   alone find its row, so a shard misses its capacity by part of a row for each cut.
5. Files that lie whole in a block that stays are left untouched.  Rows of the others are written to the folders of their new
   shards, and a manifest of files, written last, makes the layout; readers go through it, and a rewrite that fails leaves the
   old layout as it was.

The driver holds chunk sums (at most ``CHUNKS`` and one for each file), single rows of 2, cuts, and the names of files.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, work_path, written

#: Shards after and before; parts of a shard above which a row is placed by itself; chunks that sums are kept for.
SHARDS, OLD_SHARDS, FINE, CHUNKS = 24, 16, 256, 1 << 14
#: Rows of a plan up to which it is broadcast, and kept files up to which they are named to the scan.
_BROADCAST, _NAMED = 200_000, 1_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and eight for its number."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def min_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """The cheapest whole amounts from supplies to demands of the same sum; cost(i, j) is that of one unit.

    By default staying (i = j) is free and moving costs one.  Each round sends as much as fits down a cheapest path of the residual
    graph (Bellman-Ford, as undoing a shipment has a negative cost), so the flow is a cheapest one of its amount at any time.
    """
    if sum(supply) != sum(demand) or min([*supply, *demand], default=0) < 0:
        raise ValueError("supplies and demands must be of one sum and not negative")
    m, n = len(supply), len(demand)
    price = [[(cost or (lambda i, j: int(i != j)))(i, j) for j in range(n)] for i in range(m)]
    left, room, flow = list(supply), list(demand), defaultdict(int)
    while any(left):
        far = [0 if x else None for x in left] + [None] * n  # distances: supplies, then demands
        came: dict[int, int] = {}
        changed = True
        while changed:
            changed = False
            steps = [(i, m + j, price[i][j]) for i in range(m) for j in range(n)] + [(m + j, i, -price[i][j]) for (i, j), x in flow.items() if x]
            for u, v, c in steps:
                if far[u] is not None and (far[v] is None or far[u] + c < far[v]):
                    far[v], came[v], changed = far[u] + c, u, True
        end = min((m + j for j in range(n) if room[j]), key=lambda v: (far[v], v))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        back = [(v, u - m) for u, v in zip(path, path[1:]) if u >= m]
        amount = min([left[path[0]], room[end - m], *[flow[e] for e in back]])
        for u, v in zip(path, path[1:]):
            if u < m:
                flow[u, v - m] += amount
            else:
                flow[v, u - m] -= amount
        left[path[0]] -= amount
        room[end - m] -= amount
    return {e: x for e, x in flow.items() if x}


def capacities(loads: list[int], total: int) -> list[int]:
    """Room for each shard so that loads and rooms reach a common level; the rooms add up to the total."""
    level, below = 0, sorted(loads)
    for k in range(1, len(below) + 1):  # the k least loaded shards take all of it
        level = (total + sum(below[:k])) // k
        if k == len(below) or level <= below[k]:
            break
    rooms = [max(0, level - x) for x in loads]
    short = total - sum(rooms)
    for j in sorted(range(len(loads)), key=lambda j: (loads[j], j))[:short]:
        rooms[j] += 1
    return rooms


def place_large(rows: list[tuple[int, int]], shards: int, level: int) -> tuple[list[int], list[int]]:
    """(shard of each row, bytes of each shard) for rows (old shard, size) placed one by one: the largest first, those that fit
    under the level at home stay, the others go to the emptiest shard."""
    loads, place = [0] * shards, [-1] * len(rows)
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][1], k))
    for k in order:
        home, size = rows[k]
        if home < shards and (loads[home] + size <= level or not loads[home]):
            place[k] = home
            loads[home] += size
    heap = [(x, j) for j, x in enumerate(loads)]
    heapq.heapify(heap)
    for k in order:
        if place[k] < 0:
            load, place[k] = heap[0]
            heapq.heapreplace(heap, (load + rows[k][1], place[k]))
    return place, [x for x, _ in sorted(heap, key=lambda h: h[1])]


@dataclass(frozen=True)
class Plan:
    """Pieces (low row, high row, shard) of each file, in order; ``home`` is a file's old shard."""

    pieces: dict[str, list[tuple[int, int, int]]]
    home: dict[str, int]
    chunk: int

    def kept(self) -> list[str]:
        """Files that stay where they are."""
        return sorted(f for f, p in self.pieces.items() if len(p) == 1 and p[0][2] == self.home[f])


def _cut_rows(sizes: DataFrame, cuts: list[tuple[int, str, int, int]]) -> dict[int, int]:
    """For cuts (number, file, chunk, bytes into the chunk): the first row behind each, by running sums of those chunks only."""
    if not cuts:
        return {}
    asked = sizes.sparkSession.createDataFrame(cuts, "cut int, file string, chunk long, at long")
    rows = sizes.join(F.broadcast(asked.select("file", "chunk").distinct()), ["file", "chunk"])  # a cut for each flow at most
    before = F.sum("small").over(Window.partitionBy("file", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) * 2 - F.col("small")
    behind = rows.withColumn("middle", before).join(F.broadcast(asked), ["file", "chunk"]).where(F.col("middle") > F.col("at") * 2)
    return {r["cut"]: r["row"] for r in behind.groupBy("cut").agg(F.min("row").alias("row")).collect()}


def plan_moves(sizes: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, cost: Callable[[int, int], int] | None = None) -> Plan:
    """The plan for written rows sizes(file, row, size)."""
    files = sizes.groupBy("file").agg((F.max("row") + 1).alias("n"), F.sum("size").alias("bytes")).orderBy("file").collect()
    rows_of, total = {f["file"]: f["n"] for f in files}, sum(f["bytes"] for f in files)
    home = {f["file"]: k % old_shards for k, f in enumerate(files)}
    chunk = max(1, -(-sum(rows_of.values()) // CHUNKS))

    large = F.col("size") * (shards * FINE) > total
    single = sizes.where(large).select("file", "row", "size").orderBy("file", "row").collect()  # fewer than shards * FINE
    place, loads = place_large([(home[r["file"]], r["size"]) for r in single], shards, -(-total // shards))

    sizes = sizes.withColumn("chunk", F.floor(F.col("row") / chunk)).withColumn("small", F.when(large, 0).otherwise(F.col("size")))
    sums = sizes.groupBy("file", "chunk").agg(F.sum("small").alias("bytes")).orderBy("file", "chunk").collect()
    line = [[r for r in sums if home[r["file"]] == i] for i in range(old_shards)]
    supply = [sum(r["bytes"] for r in part) for part in line]
    flow = min_cost_flow(supply, capacities(loads, sum(supply)), cost)

    ends: list[list[tuple[int, int]]] = []  # for each old shard: (bytes up to which rows go there, shard), what stays first
    for i in range(old_shards):
        order = sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)) or [i % shards]
        ends.append(list(zip(accumulate(flow.get((i, j), 0) for j in order), order)))
    cuts, where = [], {}
    for i, part in enumerate(line):
        upto = list(accumulate(r["bytes"] for r in part))
        for stop, _ in ends[i][:-1]:
            k = min(bisect_right(upto, stop), len(part) - 1)
            where[i, stop] = (len(cuts), part[k]["file"], (part[k]["chunk"] + 1) * chunk)
            cuts.append((len(cuts), part[k]["file"], part[k]["chunk"], stop - upto[k] + part[k]["bytes"]))
    found = _cut_rows(sizes, cuts)

    pieces: dict[str, list[tuple[int, int, int]]] = {}
    alone = defaultdict(list)
    for r, j in zip(single, place):
        alone[r["file"]].append((r["row"], j))
    for i in range(old_shards):
        mine = [f for f in rows_of if home[f] == i]
        stops = [(where[i, stop], j) for stop, j in ends[i][:-1]]
        stops = [((f, min(found.get(k, high), rows_of[f])), j) for (k, f, high), j in stops]
        for f in mine:
            at, cut = 0, []
            while stops and stops[0][0][0] == f:
                (_, row), j = stops.pop(0)
                cut.append((at, row, j))
                at = max(at, row)
            cut.append((at, rows_of[f], stops[0][1] if stops else ends[i][-1][1]))
            pieces[f] = _merged(_with_single(cut, alone[f]))
    return Plan(pieces, home, chunk)


def _with_single(pieces: list[tuple[int, int, int]], alone: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The pieces with rows (row, shard) cut out of them."""
    out, k = [], 0
    for low, high, shard in pieces:
        while k < len(alone) and alone[k][0] < high:
            row, own = alone[k]
            out += [(low, row, shard), (row, row + 1, own)]
            low, k = row + 1, k + 1
        out.append((low, high, shard))
    return out


def _merged(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The pieces without empty ones, neighbours of one shard joined."""
    out: list[tuple[int, int, int]] = []
    for low, high, shard in pieces:
        if low < high:
            if out and out[-1][2] == shard:
                low = out.pop()[0]
            out.append((low, high, shard))
    return out


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= _BROADCAST else df


def _located(df: DataFrame) -> DataFrame:
    """All columns in a struct of their own, so that none can clash, with file and row number."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


@dataclass(frozen=True)
class Layout:
    """Files of shards: ``manifest`` (file, shard, first, rows) says which file's rows have which places in which shard."""

    roots: list[str]
    schema: T.StructType
    manifest: DataFrame
    files: int

    def rows(self, shard: str = "shard", slot: str = "slot") -> DataFrame:
        """All rows, as the files have them, with shard and slot (from 0, without gaps in each shard); columns of these names are replaced."""
        spark, known = self.manifest.sparkSession, self.manifest
        found = None
        for root in self.roots:
            part = _located(spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(root))
            found = part if found is None else found.unionAll(part)
        placed = found.join(_bounded(known, self.files), "file").withColumn("place", F.col("first") + F.col("row"))
        others = [F.col(f"r.`{c}`") for c in self.schema.names if c not in (shard, slot)]
        return placed.select(*others, F.col("shard").alias(shard), F.col("place").alias(slot))


def reshard(spark: SparkSession, path: str, shards: int = SHARDS, old_shards: int = OLD_SHARDS, size: Column | None = None, cost: Callable[[int, int], int] | None = None) -> Layout:
    """The Parquet folder (or file) at ``path`` dealt anew into shards 0 to ``shards`` - 1 of near equal bytes.

    ``size`` is a row's (by default that of ``text_size`` of column text); a row larger than a shard has one to itself as far as
    can be.  Columns pass through unread, whatever their names; an empty table makes an empty layout.  Equal texts are not kept
    together, as a group of them may be larger than a shard.
    """
    source = spark.read.parquet(path)
    with Scratch(spark, "resharding") as scratch:
        size = text_size(F.col("text")) if size is None else size
        sizes = scratch.written(source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), size.alias("size")), "sizes")
        plan = plan_moves(sizes, shards, old_shards, cost)
    kept = plan.kept()
    moved = sorted(set(plan.pieces) - set(kept))
    first = [0] * shards
    manifest: list[tuple[str, int, int, int]] = []

    def listed(file: str, shard: int, n: int) -> None:
        manifest.append((file, shard, first[shard], n))
        first[shard] += n

    for f in kept:
        listed(f, plan.home[f], plan.pieces[f][0][1])
    roots = [path] if kept or not moved else []
    if moved:
        target = work_path(spark, "shards")
        _rewrite(spark, source, target, plan, moved)
        new = spark.read.schema(source.schema).option("recursiveFileLookup", "true").parquet(target)
        for r in new.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).orderBy("file").collect():
            listed(r["file"], int(r["file"].rsplit("=", 1)[1].split("/")[0]), r["n"])
        roots.append(target)
    table = written(spark.createDataFrame(manifest, "file string, shard int, first long, rows long"), "manifest")
    return Layout(roots, source.schema, table, len(manifest))


def _rewrite(spark: SparkSession, source: DataFrame, target: str, plan: Plan, moved: list[str]) -> None:
    """Writes the rows of the moved files to a folder for each shard.

    Pieces are cut at chunks and found by file and chunk, so that a file of many pieces costs its rows no more."""
    spans = [
        (f, c, max(low, c * plan.chunk), min(high, (c + 1) * plan.chunk), shard)
        for f in moved for low, high, shard in plan.pieces[f] for c in range(low // plan.chunk, (high - 1) // plan.chunk + 1)
    ]
    spans = spark.createDataFrame(spans, "file string, chunk long, low long, high long, shard int")
    rows = _located(source)
    rows = rows.where(F.col("file").isin(moved)) if len(moved) <= _NAMED else rows
    found = rows.withColumn("chunk", F.floor(F.col("row") / plan.chunk)).join(_bounded(spans, CHUNKS), ["file", "chunk"]).where("low <= row AND row < high")
    name = "__shard"
    while name in source.columns:
        name += "_"
    found.select("r.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(target)
