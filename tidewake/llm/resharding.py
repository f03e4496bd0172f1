"""Resharding by minimum-cost flow.

Rows lie in old shards; the new shards shall hold nearly equal bytes (the law
`bytes`). Each old shard is cut into blocks by a hash of identifier and text, BLOCKS at
most in all, and only the blocks' sizes come to the driver. A minimum-cost flow
from old shards to new ones, where a byte that stays costs nothing and a byte that
moves costs one, says how many bytes go where; whole blocks, the largest first,
fill those amounts. Rows follow their block; a row's slot is its block's first slot
plus its place in the block, so no shard is ever sorted as a whole. A block that is much
larger than the mean, as one of many equal rows, is first cut into parts by row, as many
as it has means; that adds as many parts as there are blocks at most.

Defined results: a null text has size 1; equal rows can be told apart by their place
only, so any of them may lie in any place that they hold, in several shards if they are
many; rows that repeat a doc_id, or have none, each get a place of their own; a very
long text makes its shard larger by itself at most; an empty table gives an empty table;
more shards than rows leave shards empty. Other columns of the input play no part in the
placement.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict, deque
from collections.abc import Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import delete, table, written

#: The most blocks, whatever the input: what the driver holds and broadcasts.
BLOCKS = 65_536
OLD_SHARDS, NEW_SHARDS = 12, 16
#: Blocks of so many means are cut.
LARGE = 4


def min_cost_flow(supply: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard: all of supply placed, no room exceeded, fewest bytes moved.

    Old shard i is new shard i where both exist. Successive shortest paths on source - old - new - sink.
    """
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edges: [to, left, cost, index of the reverse edge]

    def edge(a: int, b: int, most: int, cost: int) -> list[int]:
        graph[a].append([b, most, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    for j, x in enumerate(room):
        edge(n + j, sink, x, 0)
    across = {(i, j): edge(i, n + j, supply[i], int(i != j)) for i in range(n) for j in range(m)}
    while True:
        dist, via, queue = {source: 0}, {}, deque([source])
        while queue:  # costs on reverse edges are negative: label correcting
            a = queue.popleft()
            for k, (b, left, cost, _) in enumerate(graph[a]):
                if left and dist[a] + cost < dist.get(b, 1 << 60):
                    dist[b], via[b] = dist[a] + cost, (a, k)
                    queue.append(b)
        if sink not in dist:
            break
        path, at = [], sink
        while at != source:
            path.append(graph[via[at][0]][via[at][1]])
            at = via[at][0]
        push = min(e[1] for e in path)
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    return {k: supply[k[0]] - e[1] for k, e in across.items() if supply[k[0]] > e[1]}


def place(blocks: list[tuple[int, Hashable, int, int]], shards: int) -> tuple[dict[tuple[int, Hashable], tuple[int, int]], int]:
    """blocks: (old shard, block, bytes, rows). Returns new shard and first slot of each (old shard, block), and the bytes moved."""
    supply: dict[int, int] = defaultdict(int)
    for old, _, size, _ in blocks:
        supply[old] += size
    total, olds = sum(supply.values()), max(supply, default=-1) + 1
    room = [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow([supply[i] for i in range(olds)], room)
    wants: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (i, j), x in flow.items():
        heapq.heappush(wants[i], (-x, j))
    out, slots, moved = {}, [0] * shards, 0
    filled = [0] * shards
    spill = []
    for old, block, size, rows in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        left, j = wants[old][0]
        if filled[j] + size <= room[j] or size > room[j]:
            heapq.heapreplace(wants[old], (left + size, j))
        else:  # whole blocks leave small gaps: these go where there is most room
            spill.append((old, block, size, rows))
            continue
        filled[j] += size
        out[old, block] = j
    for old, block, size, _ in spill:
        j = max(range(shards), key=lambda k: (room[k] - filled[k], k == old, -k))
        filled[j] += size
        out[old, block] = j
    places = {}
    for old, block, size, rows in sorted(blocks):
        j = out[old, block]
        places[old, block] = (j, slots[j])
        slots[j] += rows
        moved += size * (j != old)
    return places, moved


def sized(docs: DataFrame, id_col: str, text_col: str, old_shard: Column | None, old_shards: int, whole: bool) -> DataFrame:
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    old = (F.pmod(key, F.lit(old_shards)) if old_shard is None else old_shard).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct("*").alias("row")] if whole else []
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old.alias("old_shard"), *row)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BLOCKS // old_shards)).cast("int"))


def cut_large(rows: DataFrame, blocks: list) -> DataFrame:
    """rows with part: 0, or for the rows of a large block one of as many parts as the block has means of bytes."""
    spark = rows.sparkSession
    mean = max(1, sum(b["bytes"] for b in blocks) // BLOCKS)
    large = [(b["old_shard"], b["block"], -(-b["bytes"] // mean)) for b in blocks if b["n"] > 1 and b["bytes"] > LARGE * mean]
    if not large:
        return rows.withColumn("part", F.lit(0).cast("long"))
    large = F.broadcast(spark.createDataFrame(large, "old_shard int, block int, parts long"))  # BLOCKS / LARGE rows at most
    # written, as a row has its part by where it is read
    apart = rows.join(large, ["old_shard", "block"]).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts")).drop("parts")
    return rows.join(large, ["old_shard", "block"], "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(written(apart, "parts-of-blocks"))


def reshard(docs: DataFrame, shards: int = NEW_SHARDS, old_shard: Column | None = None, old_shards: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every row, and row, all its columns, if whole; old_shard: by default a hash of the identifier."""
    spark = docs.sparkSession
    rows, amounts = sized(docs, id_col, text_col, old_shard, old_shards, whole), [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")]
    blocks = rows.groupBy("old_shard", "block").agg(*amounts).collect()  # BLOCKS rows at most
    rows = cut_large(rows, blocks)
    blocks = rows.groupBy("old_shard", "block", "part").agg(*amounts).collect()  # twice as many at most
    places, _ = place([(b["old_shard"], (b["block"], b["part"]), b["bytes"], b["n"]) for b in blocks], shards)
    plan = spark.createDataFrame([(old, *block, *at) for (old, block), at in places.items()], "old_shard int, block int, part long, shard int, first long")
    order = Window.partitionBy("old_shard", "block", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(plan), ["old_shard", "block", "part"])
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("place")).alias("slot"), *(["row"] if whole else []))


def rewrite(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write the shards that gain or lose rows to path, one folder `shard=<number>` each, and return their numbers and how many rows they hold now.

    Every row is written once with its own columns (own columns named shard and slot are
    replaced), whatever its doc_id. Shards that nothing moves into or out of, and other folders
    in path, stay as they are; a shard that loses all its rows loses its folder. New folders are
    written beside path first and then take the place of the old ones one by one; docs may
    come from path itself.
    """
    spark = docs.sparkSession
    placed = written(reshard(docs, whole=True, **how), "placed")
    moved = placed.where("old_shard != shard")
    touched = [r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()]  # a row for each shard at most
    rows = placed.where(F.col("shard").isin(touched))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    stage = f"{path.rstrip('/')}_stage_{uuid.uuid4().hex}"
    rows.select(*own, "shard", "slot").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(stage)
    counts = rows.groupBy("shard").count().collect()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for k in sorted(touched):
        new, old, aside = at(f"{stage}/shard={k}"), at(f"{path}/shard={k}"), at(f"{path}/_before_shard={k}")
        if fs.exists(old) and not fs.rename(old, aside):
            raise OSError(f"can't set {old} aside")
        if fs.exists(new) and not fs.rename(new, old):
            if fs.exists(aside):
                fs.rename(aside, old)
            raise OSError(f"can't put {new} in place")
        fs.delete(aside, True)
    delete(spark, stage)
    return spark.createDataFrame([tuple(r) for r in counts], "shard int, count long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
