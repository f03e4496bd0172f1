"""Greedy packing in the order of a key's rows, without one task for each key.

Where a group ends follows from where it begins: sums from the start and a search in them
give each row's next start, and following the next starts, two, four, eight steps at a
time, marks all starts. So rows are dealt out by ranges of key and place, and a part works
out its groups by array operations alone. A key may go on from one part to the next: what
a part then needs is the group that is open at its start. For that a part first hands over,
for each row where its first group could end, what would be open at its own end; the parts'
answers are followed in order, one part at a time. They are as long as the first group of a
part at most, and come from parts whose first key goes on alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged

#: Rows of a part, about; what one task holds of them is three numbers.
PART_ROWS = 1_000_000
NO_LIMIT = 1 << 62


class Chain:
    """The next starts of the rows of a part, from their costs, counts and where keys begin."""

    def __init__(self, cost: np.ndarray, rows: np.ndarray, new: np.ndarray, budget: int, most: int):
        self.n, self.budget, self.most = len(cost), budget, most
        self.cost, self.rows = (np.concatenate([[0], np.cumsum(x)]) for x in (cost, rows))
        begins = np.flatnonzero(new)
        self.ends = np.append(begins[1:], self.n)[np.cumsum(new) - 1]  # where the row's key ends
        at = np.arange(self.n)
        # a row that doesn't fit by itself is alone
        self.next = np.minimum(np.maximum(self.fits(at, 0, 0), at + 1), self.ends)

    def fits(self, at: np.ndarray, used: int, count: int) -> np.ndarray:
        """The row before which a group ends that has used and count before it takes the rows from at on."""
        by_cost = np.searchsorted(self.cost, self.cost[at] + self.budget - used, side="right") - 1
        return np.minimum(by_cost, np.searchsorted(self.rows, self.rows[at] + self.most - count, side="right") - 1)

    def marks(self, roots: np.ndarray) -> np.ndarray:
        """Which rows are starts that follow from the roots within their keys."""
        jump, out = np.append(np.where(self.next < self.ends, self.next, self.n), self.n), np.zeros(self.n + 1, bool)
        out[roots] = True
        while (jump[:-1] < self.n).any():
            out[jump[out.nonzero()[0]]] = True
            jump = jump[jump]
        return out[:-1]

    def open_at_end(self, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For groups that start at each row up to first, all in the last key: cost and count of the group that is open at the end, and how many groups there are by then."""
        last = np.where(self.next < self.n, self.next, np.arange(self.n))
        hops = (self.next < self.n).astype(np.int64)
        while ((further := last[last]) != last).any():
            hops, last = hops + hops[last], further
        at = last[: first + 1]
        return self.cost[-1] - self.cost[at], self.rows[-1] - self.rows[at], hops[: first + 1] + 1


def groups_of(chain: Chain, new: np.ndarray, before: tuple[int, int, int] | None) -> np.ndarray:
    """The group number of every row; before: cost, count and number of the group that is open at the start."""
    roots, base, lead = np.flatnonzero(new), np.zeros(chain.n, np.int64), 0
    if before is not None:
        used, count, number = before
        first = min(max(int(chain.fits(np.array([0]), used, count)[0]), 0), int(chain.ends[0]))
        roots, lead = roots[1:], int(chain.ends[0])
        if first < lead:
            roots = np.append(first, roots)
        base[:lead] = number + 1
    starts = chain.marks(roots)
    so_far = np.cumsum(starts)
    begin = np.maximum.accumulate(np.where(new, np.arange(chain.n), 0))
    return base + so_far - (so_far - starts)[begin] - 1


def packed(costs: DataFrame, key: str, seq: str, budget: int, most: int | None = None) -> DataFrame:
    """(key, seq, group) of costs (key, seq, _cost, _rows), a row for each key and place: consecutive rows of a key whose costs stay within the budget, and whose rows within most, are one group, numbered from 0; costs aren't negative."""
    spark, budget, most = costs.sparkSession, max(budget, 1), max(most, 1) if most is not None else NO_LIMIT
    costs = staged(costs, "costs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), costs.count() // PART_ROWS)
    ranged = costs.repartitionByRange(parts, key, seq).withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy("_part").orderBy(key, seq)  # a range of rows each
    fresh = ~F.lag(F.struct(key)).over(order).eqNullSafe(F.struct(key))
    rows = staged(ranged.withColumns({"_i": F.row_number().over(order) - 1, "_new": fresh}), "ranges")
    edges = rows.groupBy("_part").agg(F.min_by(F.struct(key), "_i").alias("first"), F.max_by(F.struct(key), "_i").alias("last"))
    goes_on = F.lag("last").over(Window.orderBy("_part")).eqNullSafe(F.col("first"))  # a row for each part
    edges = edges.select("_part", goes_on.alias("on"))
    edges = staged(edges, "edges")
    numbers = rows.select("_part", "_i", "_new", "_cost", "_rows")

    def chain_of(pdf: pd.DataFrame) -> tuple[Chain, np.ndarray]:
        pdf = pdf.sort_values("_i")
        new = pdf["_new"].to_numpy(bool)
        new[0] = True
        return Chain(pdf["_cost"].to_numpy(np.int64), pdf["_rows"].to_numpy(np.int64), new, budget, most), new

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        chain, new = chain_of(pdf)
        begin = int(np.flatnonzero(new)[-1])
        single = begin == 0
        if not single:  # what is open at the end doesn't depend on what was open at the start
            tail = Chain(np.diff(chain.cost)[begin:], np.diff(chain.rows)[begin:], new[begin:], budget, most)
            first, (used, count, number) = 0, tail.open_at_end(0)
        else:
            first = min(int(chain.next[0]), chain.n - 1)
            used, count, number = chain.open_at_end(first)
        sent = [chain.cost[: first + 2], chain.rows[: first + 2]] if single else [np.zeros(0, np.int64)] * 2
        return pd.DataFrame({"_part": [pdf["_part"].iloc[0]], "single": [single], "n": [chain.n], "blobs": [[x.astype(np.int64).tobytes() for x in (*sent, used, count, number)]]})

    # only parts that another one goes on from, or that go on
    wanted = edges.withColumn("next_on", F.coalesce(F.lead("on").over(Window.orderBy("_part")), F.lit(False))).where("on or next_on")
    told = numbers.join(F.broadcast(wanted.select("_part")), "_part").groupBy("_part").applyInPandas(summary, "_part int, single boolean, n long, blobs array<binary>")
    told = staged(told, "ends")
    on, before, state, last = {r["_part"] for r in edges.where("on").collect()}, {}, None, None  # a number for each part at most
    for r in told.orderBy("_part").toLocalIterator():  # a part's first group at a time
        cost, rows_, used, count, number = (np.frombuffer(b, np.int64) for b in r["blobs"])
        incoming = state if r["_part"] in on else None
        if incoming is not None:
            before[r["_part"]] = incoming
        if incoming is None or not r["single"]:
            state = (int(used[0]), int(count[0]), int(number[0]) - 1)
            continue
        # the first row that doesn't fit into the open group
        first = min(int(np.searchsorted(cost, budget - incoming[0], side="right")), int(np.searchsorted(rows_, most - incoming[1], side="right"))) - 1
        first = max(first, 0)
        if first >= r["n"]:
            state = (incoming[0] + int(cost[-1]), incoming[1] + int(rows_[-1]), incoming[2])
        else:
            state = (int(used[first]), int(count[first]), incoming[2] + int(number[first]))

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        chain, new = chain_of(pdf)
        pdf = pdf.sort_values("_i")
        return pd.DataFrame({"_part": pdf["_part"], "_i": pdf["_i"], "group": groups_of(chain, new, before.get(int(pdf["_part"].iloc[0])))})

    found = numbers.groupBy("_part").applyInPandas(grouped, "_part int, _i int, group long")
    return rows.select("_part", "_i", key, seq).join(found, ["_part", "_i"]).select(key, seq, "group")
