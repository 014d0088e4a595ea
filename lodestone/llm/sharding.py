"""Minimax contiguous sharding: the smallest feasible shard capacity over ordered atomic groups, then cuts there.

Groups are documents with equal texts; a group is never split. Groups are ordered by the SHA-256 of their text,
so an order key is uniform whatever the data, and blocks of the order are even. Inclusive prefix sums P of the
group sizes turn the greedy check of a capacity C into look-ups: a shard that starts at x ends at the largest
prefix F(x + C) = max{P : P <= x + C}. All per-row work is DataFrame operations. The binary search itself runs
on a grid of at most GRID cells that one aggregation returns, with bounds on F where a cell holds several
prefixes; while the bounds leave more than one capacity open, the cells that still matter are cut finer by a
further aggregation over pushed-down ranges of P. Sizes of 100 TB settle in four such passes.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells that one pass sends to the driver, at most.
GRID = 1 << 14
#: Blocks of the group order; one window partition each.
BLOCKS = 1 << 12
#: Buckets that the rows of one group are numbered in.
SUBS = 256


def _steps(cells: list[tuple[int, int]], capacity: int, shards: int, upper: bool) -> list[int]:
    """Ends of the greedy shards at this capacity, from below or above, given each cell's (least, largest) prefix."""
    lows = [c[0] for c in cells]
    at, ends = 0, []
    for _ in range(shards):
        x = at + capacity
        i = bisect.bisect_right(lows, x) - 1
        if i < 0:
            reach = 0
        elif x >= cells[i][1]:
            reach = cells[i][1]
        else:  # least <= x < largest: some prefix of this cell, at most x
            reach = x if upper else cells[i][0]
        at = max(at, reach)
        ends.append(at)
    return ends


def _search(prefixes: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity over the prefix column p, and the greedy cuts (ends of all shards but the last)."""
    lo, hi = max(-(-total // shards), largest) - 1, -(-total // shards) + largest  # infeasible, feasible
    width, cells, windows = max(1, -(-total // GRID)), [], [(1, total)]
    while True:
        near = None
        for a, b in windows:
            near = F.col("p").between(a, b) if near is None else near | F.col("p").between(a, b)
        cell = F.expr(f"p div {width}L")
        finer = prefixes.where(near).groupBy(cell.alias("c")).agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()
        # a cell that a window touches is replaced as a whole: windows are made of whole cells
        kept = [c for c in cells if not any(a <= c[0] and c[1] <= b for a, b in windows)]
        cells = sorted([*kept, *((r.a, r.b) for r in finer)])
        low, high = lo, hi  # low: surely infeasible; high: surely feasible
        a, b = low, high
        while b - a > 1:  # smallest capacity that is surely feasible
            mid = (a + b) // 2
            a, b = (a, mid) if _steps(cells, mid, shards, False)[-1] >= total else (mid, b)
        high = b
        a, b = low, high
        while b - a > 1:  # largest capacity that is surely infeasible
            mid = (a + b) // 2
            a, b = (mid, b) if _steps(cells, mid, shards, True)[-1] < total else (a, mid)
        low = a
        lo, hi = low, high
        below, above = _steps(cells, lo + 1, shards, False), _steps(cells, hi, shards, True)
        if hi - lo == 1 and _steps(cells, hi, shards, False) == above:
            return hi, above[:-1]
        lows = [c[0] for c in cells]
        windows = []
        for x, y in zip(below, above, strict=True):  # cells where a greedy end can still lie
            i, j = max(0, bisect.bisect_right(lows, x) - 1), max(0, bisect.bisect_right(lows, y) - 1)
            while j > i and cells[j][0] == cells[j][1]:
                j -= 1
            while i < j and cells[i][0] == cells[i][1]:
                i += 1
            if cells[i][0] < cells[j][1]:
                windows.append((cells[i][0], cells[j][1]))
        windows = _union(windows)
        width = max(1, -(-sum(b - a + 1 for a, b in windows) // (GRID // 2)))


def _union(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def prefix_groups(sizes: DataFrame) -> DataFrame:
    """(grp, n_rows, bytes) -> the same with inclusive prefixes p (bytes) and r (rows) in the order of grp (hex)."""
    block = F.conv(F.substring("grp", 1, 3), 16, 10).cast("int")  # 12 bits: BLOCKS
    own = Window.partitionBy("block").orderBy("grp")
    cut = sizes.withColumn("block", block)
    totals = cut.groupBy("block").agg(F.sum("bytes").alias("bb"), F.sum("n_rows").alias("br"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # BLOCKS rows at most
    starts = totals.select("block", F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("br").over(before), F.lit(0)).alias("r0"))
    inner = cut.withColumn("ip", F.sum("bytes").over(own)).withColumn("ir", F.sum("n_rows").over(own))
    return inner.join(starts, "block").select("grp", "n_rows", "bytes", (F.col("b0") + F.col("ip")).alias("p"), (F.col("r0") + F.col("ir")).alias("r"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of `shards` shards of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ("bytes"), shard, slot (gapless from 0 in each
    shard), grown_shard (null under this law). A text of any length is counted whole. A null text counts as no bytes and shares the group of the empty
    text. Repeated rows each get a slot; null ids are kept; other columns are not read. No rows, no result rows.
    With fewer groups than shards some shards stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("grp"))
    rows = common.durable(rows.withColumn("sub", common.by_row(SUBS)), "shard-rows")
    part = rows.groupBy("grp", "sub").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    sizes = part.groupBy("grp").agg(F.sum("c").alias("n_rows"), F.sum("s").alias("bytes"))
    groups = common.durable(prefix_groups(sizes).sortWithinPartitions("p"), "shard-groups")
    top = groups.agg(F.max("p").alias("total"), F.max("bytes").alias("largest")).first()
    cuts = _search(groups.select("p"), top.total, top.largest, shards)[1] if top.total else []
    first = F.col("p") - F.col("bytes")  # where the group starts
    number = sum((F.when(first >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    ends = groups.agg(*[F.max(F.when(F.col("p") <= c, F.col("r"))).alias(f"r{k}") for k, c in enumerate(cuts)], F.lit(0).alias("none")).first()
    base = F.array(F.lit(0).cast("long"), *[F.lit(ends[k] or 0).cast("long") for k in range(len(cuts))])
    placed = groups.select("grp", number.alias("shard"), (F.col("r") - F.col("n_rows") - F.element_at(base, number + 1)).alias("first_slot"))
    # groups -> their sub-buckets (at most SUBS a group) -> rows; the joins to rows are on (grp, sub), which no large group can heat
    w = Window.partitionBy("grp").orderBy("sub")
    starts = part.withColumn("before", F.sum("c").over(w) - F.col("c")).join(placed, "grp").select("grp", "sub", "shard", (F.col("first_slot") + F.col("before")).alias("start"))
    inner = rows.withColumn("rn", F.row_number().over(Window.partitionBy("grp", "sub").orderBy("doc_id", "size")) - 1)
    return inner.join(starts, ["grp", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
