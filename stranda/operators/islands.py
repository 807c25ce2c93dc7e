"""Merging, compacting and tiling of intervals (IJ) by gaps and islands."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16


def merge(df: DataFrame, by: list[str], adjacent: bool = False, tile: int = TILE) -> DataFrame:
    """IJ-06: merged intervals (by..., start_, end_, n members); empty ones are left out.

    One sort inside tiles makes a row for each island of a tile; how far the tiles before reach, and where what reaches in began, is
    carried over in a row for each tile, so no chromosome is one task and islands meet across tiles without another sort."""
    touch = int(adjacent)
    df = df.filter("start_ <= end_").select(*by, "start_", "end_", F.floor(F.col("start_") / tile).alias("tile"))
    inside = Window.partitionBy(*by, "tile").orderBy("start_", "end_")
    reach = F.max("end_").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(reach.isNull() | (F.col("start_") > reach + touch), 1).otherwise(0))
    df = df.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = df.groupBy(*by, "tile", "_run").agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.count("*").alias("n"))
    # a tile's islands are apart, so those that what comes in reaches are its first ones; the last that begins anew is handed on
    local = carry(local, by, F.max("end_"), F.max, "_open")
    anew = F.col("_open").isNull() | (F.col("start_") > F.col("_open") + touch)
    local = local.withColumn("_begin", F.when(anew, F.col("start_")))
    local = carry(local, by, F.max("_begin"), F.max, "_from")
    return local.groupBy(*by, F.coalesce("_begin", "_from").alias("_at")).agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.sum("n").alias("n")).drop("_at")


def carry(df: DataFrame, by: list[str], each: Column, over: Callable[[str], Column], name: str) -> DataFrame:
    """df with `name`: over all tiles before a row's tile, what `over` makes of each tile's aggregate; null in the first."""
    before = Window.partitionBy(*by).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = df.groupBy(*by, "tile").agg(each.alias("_x")).withColumn(name, over("_x").over(before)).drop("_x")
    keys = [*by, "tile"]
    tiles = tiles.select(*(F.col(c).alias(f"_key_{c}") for c in keys), name)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys))
    return df.join(tiles, same).drop(*(f"_key_{c}" for c in keys))


def _numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Numbers runs in `_run`; a row with _new = 1 begins one."""
    df = carry(df, by, F.sum("_new"), F.sum, "_before")
    inside = Window.partitionBy(*by, "tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_run", F.coalesce("_before", F.lit(0)) + F.sum("_new").over(inside))


def compact(df: DataFrame, tile: int = TILE) -> DataFrame:
    """IJ-20: runs of adjacent intervals with equal values, by chromosome; sorted only inside tiles, as merge."""
    df = df.select("chrom", "start_", "end_", "value", F.floor(F.col("start_") / tile).alias("tile"))
    last = F.max(F.struct("start_", "end_", "value"))
    df = carry(df, ["chrom"], last, F.max, "_left")
    order = Window.partitionBy("chrom", "tile").orderBy("start_", "end_")
    left = F.coalesce(F.lag(F.struct("start_", "end_", "value")).over(order), F.col("_left"))
    df = df.withColumn("_l", left)
    same = (F.col("_l.end_") + 1 == F.col("start_")) & F.col("_l.value").eqNullSafe(F.col("value"))
    marked = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return _numbered(marked, ["chrom"], ["start_", "end_"]).groupBy("chrom", "_run").agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.first("value").alias("value")).drop("_run")


def tile_counts(df: DataFrame, size: int) -> DataFrame:
    """IJ-10: (chrom, tile, n) for each tile that an interval touches; an interval counts in each of its tiles."""
    at = lambda c: F.floor((F.col(c) - 1) / size)
    return df.filter("start_ <= end_").select("chrom", F.explode(F.sequence(at("start_"), at("end_"))).alias("tile")).groupBy("chrom", "tile").agg(F.count("*").alias("n"))


def depth(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """RD-10: runs (chrom, start_, end_, depth) of equal depth above 0, of intervals chrom, start_, end_.

    Each interval is +1 where it begins and -1 behind its end; the changes are summed by position, then run up inside tiles,
    with what is open at each tile's left edge carried over, so no chromosome is one task."""
    ends = blocks.filter("start_ <= end_").select("chrom", F.explode(F.array(F.struct(F.col("start_").cast("long").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct((F.col("end_") + 1).cast("long").alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("x"))
    change = ends.groupBy("chrom", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).withColumn("tile", F.floor(F.col("pos") / tile))
    before = Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = change.groupBy("chrom", "tile").agg(F.sum("d").alias("all")).select("chrom", "tile", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("open"), F.lead("tile").over(Window.partitionBy("chrom").orderBy("tile")).alias("next"))
    inside = Window.partitionBy("chrom", "tile").orderBy("pos")
    run = change.withColumns({"run": F.sum("d").over(inside), "behind": F.lead("pos").over(inside)})
    first = change.groupBy("chrom", "tile").agg(F.min("pos").alias("first"))
    # a tile's last run lasts until the first change in the next tile that has one
    edges = carried.join(first.select("chrom", F.col("tile").alias("next"), F.col("first").alias("edge")), ["chrom", "next"], "left").drop("next")
    all_ = run.join(edges, ["chrom", "tile"]).select("chrom", F.col("pos").alias("start_"), (F.coalesce("behind", "edge") - 1).alias("end_"), (F.col("run") + F.col("open")).alias("depth"))
    return all_.filter("depth > 0")


def grouped(df: DataFrame, by: list[str], key: list[str], adjacent: bool = False) -> DataFrame:
    """IJ-08, overlap: df's rows, each with the group (group_start, group_end) of overlapping intervals it is in."""
    from .joins import overlap_pairs

    groups = merge(df, by, adjacent).select(*by, "start_", "end_")
    pairs = overlap_pairs(df, groups, stranded="strand" in by)
    return pairs.select(*df.columns, F.col("r_start_").alias("group_start"), F.col("r_end_").alias("group_end"))


def tiles(df: DataFrame, size: int) -> DataFrame:
    """IJ-11: (chrom, tile, start_, end_) up to each chromosome's last position, whether anything is there or not."""
    lengths = df.groupBy("chrom").agg(F.max("end_").alias("length"))
    each = lengths.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("tile"))
    return each.select("chrom", "tile", (F.col("tile") * size + 1).alias("start_"), F.least((F.col("tile") + 1) * size, "length").alias("end_"))


def neighbours(df: DataFrame, id_: str, chroms: list[str] | None = None, max_dist: int | None = None, tile: int = TILE) -> DataFrame:
    """IJ-19: (id, prev, next): the ids before and behind each interval in the order of chromosomes (as in chroms, else by name), starts, ends and
    ids; neighbours on other chromosomes count, unless max_dist is set: then those farther away, or elsewhere, are null.

    Sorted inside tiles; a tile hands on its first and last interval, so only a row for each tile is sorted in one place."""
    rank = F.array_position(F.array(*map(F.lit, chroms)), F.col("chrom")) if chroms else F.lit(0)
    rows = df.select(F.col(id_).alias("id"), "chrom", "start_", "end_", rank.alias("_rank"), F.floor(F.col("start_") / tile).alias("_tile"))
    order = ["start_", "end_", "id"]
    one = F.struct(*order, "chrom")
    inside = Window.partitionBy("_rank", "chrom", "_tile").orderBy(*order)
    rows = rows.withColumns({"_prev": F.lag(one).over(inside), "_next": F.lead(one).over(inside)})
    along = Window.partitionBy(F.lit(0)).orderBy("_rank", "chrom", "_tile")
    ends = rows.groupBy("_rank", "chrom", "_tile").agg(F.min(one).alias("_first"), F.max(one).alias("_last"))
    ends = ends.select("_rank", "chrom", "_tile", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    both = rows.join(ends, ["_rank", "chrom", "_tile"]).withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})

    def near(side: str) -> Column:
        if max_dist is None:
            return F.col(f"{side}.id")
        gap = F.greatest(F.col("start_") - F.col(f"{side}.end_"), F.col(f"{side}.start_") - F.col("end_"), F.lit(0))
        return F.when((F.col(f"{side}.chrom") == F.col("chrom")) & (gap <= max_dist), F.col(f"{side}.id"))

    return both.select("id", near("_prev").alias("prev"), near("_next").alias("next"))


def groups(df: DataFrame, strategy: str, members: list[str], by: list[str] | None = None, adjacent: bool = False) -> DataFrame:
    """IJ-08: one row for each group of intervals: by (chrom, if not given; chrom and strand keep strands apart), start_ and end_ of its hull, n, and
    members, a sorted array of (start_, end_, and the columns named).

    strategy: start, end or both (alike in these, wherever they stand in the table) or overlap (chains of overlapping intervals, or
    touching ones with adjacent). A group's array is as long as the group: for numbers alone, group by the same keys."""
    by = by or ["chrom"]
    own = {"start": ["start_"], "end": ["end_"], "both": ["start_", "end_"], "overlap": ["group_start", "group_end"]}
    if strategy not in own:
        raise ValueError(f"unknown strategy {strategy}")
    rows = df.select(*by, "start_", "end_", *members)
    if strategy == "overlap":
        rows = grouped(rows, by, members, adjacent)
    listed = F.array_sort(F.collect_list(F.struct("start_", "end_", *members)))
    keys = [*by, *(F.col(c).alias(f"_{c}") for c in own[strategy])]
    out = rows.groupBy(*keys).agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.count("*").alias("n"), listed.alias("members"))
    return out.select(*by, "start_", "end_", "n", "members")


#: LS-03: what holds between a value and the one before
STEPS: dict[str, Callable[[Column, Column], Column]] = {
    "inc": lambda x, before: x > before,
    "dec": lambda x, before: x < before,
    "inceq": lambda x, before: x >= before,
    "deceq": lambda x, before: x <= before,
    "inc1": lambda x, before: x == before + 1,
    "dec1": lambda x, before: x == before - 1,
    "eq": lambda x, before: x == before,
}


def steps(df: DataFrame, by: list[str], order: list[str], column: str, modes: list[str]) -> DataFrame:
    """LS-03: by, and for each mode of STEPS whether all values of a column follow it in an order; true for one value."""
    rows = df.select(*by, F.col(column).alias("_x"), F.lag(column).over(Window.partitionBy(*by).orderBy(*order)).alias("_before"))
    return rows.groupBy(*by).agg(*(F.coalesce(F.bool_and(STEPS[m](F.col("_x"), F.col("_before"))), F.lit(True)).alias(m) for m in modes))
