"""Interval joins on dyadic cells, and the nearest neighbour in time on both sides.

Time is cut into cells of `grain_us`, cells into pairs, pairs into fours and so on for
`levels` levels. An interval is filed in the fewest cells that cover it: at most two a level,
so 2 log2 of its length in grains. A point looks up the cell it lies in on every level:
the covers are disjoint, so it meets each interval around it exactly once. Two intervals
meet if the start of one lies in the other. Keys are (keys, level, cell): a record with very
many intervals is spread over tasks, and what lies far apart is never compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Width of the finest cells and number of levels above them. An interval of more than one cell of the top level has a row for each."""

    grain_us: int = 1 << 20
    levels: int = 12

    @staticmethod
    def of(df: DataFrame, lo: str, hi: str) -> Grid:
        """Cells of about the mean length, levels up to the longest interval: one aggregate over two columns."""
        size = F.col(hi) - F.col(lo)
        mean, most = df.where(size >= 0).agg(F.avg(size), F.max(size)).first()
        grain = 1 << max(0, int(mean or 1).bit_length() - 1)
        return Grid(grain, max(0, (int(most or 0) // grain).bit_length()))


#: For words, of a second or less, and for turns, of some 16 seconds: longer ones are filed in more cells.
WORDS, TURNS = Grid(1 << 20, 12), Grid(1 << 24, 4)


def in_cells(df: DataFrame, lo: str, hi: str, filed: Grid | None, asked: Grid | None, outer: bool = False) -> DataFrame:
    """df with _by, _level and _cell: the cover of the interval on its own grid (_by 0), and the cells around its start on the other side's (_by 1).

    outer adds a row that meets nothing (_by 2), for an outer join.
    """
    grids = [g for g in (filed, asked) if g]
    if filed and asked:
        rows = df.withColumn("_by", F.explode(F.array(*map(F.lit, (0, 1, 2) if outer else (0, 1)))))
    else:
        rows = df.withColumn("_by", F.lit(0 if filed else 1))
    own = F.col("_by") == 0
    pick = lambda a, b: a if asked is None else b if filed is None else F.when(own, a).otherwise(b)
    grain = pick(*(F.lit(g.grain_us if g else 1) for g in (filed, asked)))
    top = pick(*(F.lit(g.levels if g else 0) for g in (filed, asked)))
    top = F.when(F.col("_by") == 2, 0).otherwise(top) if outer else top
    first = F.coalesce(F.floor(F.col(lo) / grain), F.lit(0).cast("long"))
    rows = rows.withColumns({"_a": first, "_b": pick(F.greatest(F.floor(F.col(hi) / grain), first) + 1, first + 1), "_top": top})
    # No cell of a cover is longer than the interval.
    highest = pick(F.least(F.col("_top"), F.floor(F.log2(F.col("_b") - F.col("_a"))).cast("int")), F.col("_top"))
    rows = rows.where("_a < _b").withColumn("_level", F.explode(F.sequence(F.lit(0), highest)))
    if filed:
        # The whole cells of a level lie between these; what is odd at either end has no whole parent.
        rows = rows.withColumns({"_a": pick(F.expr("-shiftright(-_a, _level)"), F.expr("shiftright(_a, _level)")), "_b": pick(F.expr("shiftright(_b, _level)"), F.expr("shiftright(_a, _level) + 1"))})
        odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
        whole = F.col("_level") == F.col("_top")
        whole = whole if asked is None else whole | ~own
        rows = rows.where((F.col("_a") < F.col("_b")) & (whole | odd("_a") | odd("_b")))
        ends = F.array(F.when(odd("_a"), F.col("_a")), F.when(odd("_b"), F.col("_b") - 1))
        rows = rows.withColumn("_cell", F.explode(F.when(whole, F.sequence(F.col("_a"), F.col("_b") - 1)).otherwise(ends))).where("_cell IS NOT NULL")
    else:
        rows = rows.withColumn("_cell", F.expr("shiftright(_a, _level)"))
    return rows.drop("_a", "_b", "_top") if len(grids) == 2 else rows.drop("_a", "_b", "_top", "_by")


def stab(intervals: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, grid: Grid | None = None) -> DataFrame:
    """Rows of both sides joined where the point lies in the closed interval of the same keys. Columns other than the keys must differ."""
    grid = grid or Grid.of(intervals, lo, hi)
    met = in_cells(intervals.where(F.col(lo) <= F.col(hi)), lo, hi, grid, None).join(in_cells(points, at, at, None, grid), [*keys, "_level", "_cell"])
    return met.where((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi))).drop("_level", "_cell")


def meet(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str], a_grid: Grid | None = None, b_grid: Grid | None = None, how: str = "inner") -> DataFrame:
    """Every pair of closed intervals of the same keys that share a point, once: b starts in a, or a starts in b after b's start.

    Columns other than the keys must differ. Touching pairs are among them; intervals that end before they
    start meet none. how = "left": every row of a comes once more with nulls, whatever it meets, for
    aggregates over a's rows (rows without times, or that end before they start, come so alone).
    """
    a_grid, b_grid = a_grid or Grid.of(a, *a_ends), b_grid or Grid.of(b, *b_ends)
    (a0, a1), (b0, b1) = (tuple(map(F.col, ends)) for ends in (a_ends, b_ends))
    left = in_cells(a if how == "left" else a.where(a0 <= a1), *a_ends, a_grid, b_grid, how == "left")
    right = in_cells(b.where(b0 <= b1), *b_ends, b_grid, a_grid).select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in keys), (1 - F.col("_by")).alias("_by2"), F.col("_level").alias("_level2"), F.col("_cell").alias("_cell2"))
    same = (F.col("_by") == F.col("_by2")) & (F.col("_level") == F.col("_level2")) & (F.col("_cell") == F.col("_cell2"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    starts = F.when(F.col("_by") == 0, (a0 <= b0) & (b0 <= a1)).otherwise((b0 < a0) & (a0 <= b1) & (a0 <= a1))
    met = left.join(right, same & F.coalesce(starts, F.lit(False)), how)
    if how == "left":
        met = met.where((F.col("_by") == 2) | F.col("_by2").isNotNull())
    return met.drop("_by", "_level", "_cell", "_by2", "_level2", "_cell2", *(f"_{k}" for k in keys))


def latest(rows: DataFrame, keys: list[str], at: str, value: str, block_us: int, name: str) -> DataFrame:
    """rows with the largest `value` among those of the same keys whose `at` is not larger, in `name`; null values ask only.

    A running maximum in two steps, so that a long record isn't one task: within blocks of
    time, and over the maxima of the blocks before. The rows are exchanged once; for the blocks' maxima they
    are combined first.
    """
    rows = rows.withColumn("_block", F.floor(F.col(at) / block_us))
    own = Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_most")).select(*keys, "_block", F.max("_most").over(before).alias("_carried"))
    found = rows.withColumn(name, F.max(value).over(own)).join(blocks, [*keys, "_block"])
    return found.withColumn(name, F.greatest(name, "_carried")).drop("_block", "_carried")


def nearest(rows: DataFrame, asks: Column, keys: list[str], grid: Grid | None = None, block_us: int = 1 << 40, empty_shares: bool = True) -> DataFrame:
    """(keys, idx, near, distance_us): for each row (keys, idx, lo, hi) that asks the nearest one that does not.

    One that shares time comes before one that touches; of several alike the first by idx. An interval without
    length within another shares its time, or only touches it (empty_shares = False). Rows whose keys
    have no others are left out. Those that share time are met on cells; the neighbours before and after
    come from running maxima of ends and, mirrored, of starts.
    """
    grid = grid or Grid.of(rows, "lo", "hi")
    rows = rows.select(*keys, "idx", "lo", "hi", asks.alias("asks"))
    a = rows.where("asks").select(*keys, "idx", F.col("lo").alias("a0"), F.col("hi").alias("a1"))
    b = rows.where("NOT asks").select(*keys, F.col("idx").alias("near"), F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    shares = (F.col("b0") < F.col("a1")) & (F.col("a0") < F.col("b1"))
    met = meet(a, b, keys, ("a0", "a1"), ("b0", "b1"), grid, grid).where(shares)
    apart = F.lit(False) if empty_shares else F.least("a1", "b1") <= F.greatest("a0", "b0")
    inside = met.select(*keys, "idx", apart.alias("apart"), F.lit(0).cast("long").alias("distance_us"), "near")
    # Two time lines: forward, on which others are told at their ends, and mirrored, at their starts.
    lines = F.explode(F.array(*(F.struct(F.lit(m).alias("mirrored"), F.when(F.col("asks"), start).otherwise(end).alias("at")) for m, start, end in ((False, F.col("lo"), F.col("hi")), (True, -F.col("hi"), -F.col("lo"))))))
    told = rows.select(*keys, "idx", "asks", lines.alias("line")).select(*keys, "idx", "asks", "line.mirrored", "line.at")
    value = F.when(~F.col("asks"), F.struct(F.col("at").alias("reach"), (-F.col("idx")).cast("long").alias("first")))
    found = latest(told.withColumn("value", value), [*keys, "mirrored"], "at", "value", block_us, "found").where("asks AND found IS NOT NULL")
    sides = found.select(*keys, "idx", F.lit(True).alias("apart"), (F.col("at") - F.col("found.reach")).alias("distance_us"), (-F.col("found.first")).alias("near"))
    best = F.min(F.struct("apart", "distance_us", "near")).alias("best")
    return inside.unionByName(sides).groupBy(*keys, "idx").agg(best).select(*keys, "idx", "best.near", "best.distance_us")
