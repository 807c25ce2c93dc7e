"""Overlap joins (IJ) as equi-joins on chromosome and bin, each pair found in one bin alone.

Bins have levels, each FACTOR times as wide as the one below. An interval is at home in the first level whose bins are as wide as
itself, where it touches two bins at most; a pair meets in the wider one's level. So an interval has two rows at most for its own level,
and two for each wider level that the other side has, whatever its length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 64
FACTOR, LEVELS = 8, 10


def widths(bin_size: int = BIN) -> list[int]:
    return [bin_size * FACTOR**i for i in range(LEVELS)]


def level(start: Column, end: Column, bin_size: int = BIN) -> Column:
    """An interval's own level; longer ones than the widest bin are in the last."""
    return reduce(lambda x, w: x + (end - start + 1 > w).cast("int"), widths(bin_size)[:-1], F.lit(0))


def _bin(place: Column, at: Column, bin_size: int) -> Column:
    """The bin of a position in level `at`."""
    return F.floor(place / F.call_function("shiftleft", F.lit(bin_size).cast("long"), at * (FACTOR.bit_length() - 1)))


def _at(place: Column) -> Column:
    """The level of a place."""
    return place % LEVELS


def _levels(df: DataFrame) -> Column:
    """The levels of a side, at most LEVELS numbers, as a scalar."""
    return df.agg(F.collect_set("_level").alias("x")).scalar()


def _sides(left: DataFrame, right: DataFrame, bin_size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (with _s, _e) with a row for each bin in which they may meet, and its place: the level, or LEVELS more where right is wider."""
    left, right = (df.withColumn("_level", level(F.col("_s"), F.col("_e"), bin_size)) for df in (left, right))
    of_left, of_right = _levels(left.select("_level")), _levels(right.select("_level"))
    own, other = F.col("_level"), F.col("_other")
    none = F.lit(-1)
    # plain numbers and conditions, no lambdas, so that all of it is compiled
    wider = lambda by, least: [F.when(F.array_contains(other, m) & least(m), F.lit(by * LEVELS + m)).otherwise(none) for m in range(LEVELS)]
    at_left = F.array(own, *wider(1, lambda m: own < m))
    at_right = F.array(F.when(own > F.array_min(other), own + LEVELS).otherwise(none), *wider(0, lambda m: own <= m))

    def spread(df: DataFrame, levels: Column, at: Column) -> DataFrame:
        each = df.withColumn("_other", levels).withColumn("place", F.explode(at)).filter("place >= 0").drop("_other", "_level")
        return each.withColumn("bin", F.explode(F.sequence(_bin(F.col("_s"), _at(F.col("place")), bin_size), _bin(F.col("_e"), _at(F.col("place")), bin_size))))

    return spread(left, of_right, at_left), spread(right, of_left, at_right)


def _meeting(left: DataFrame, right: DataFrame, bin_size: int, within: int = 0) -> tuple[DataFrame, DataFrame, Column]:
    """Left's rows and right's (r_ before their columns) by place, and the condition that they overlap there."""
    ends = lambda df, more: df.withColumns({"_s": F.col("start_") - more, "_e": F.col("end_") + more}).filter("start_ <= end_")
    a, b = _sides(ends(left, within), ends(right, 0), bin_size)
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_s") <= F.col("r__e")) & (F.col("r__s") <= F.col("_e"))
    for c in ("place", "bin"):
        on &= F.col(c) == F.col(f"r_{c}")
    return a, b, on


def overlap_pairs(left: DataFrame, right: DataFrame, bin_size: int = BIN, stranded: bool = False, within: int = 0) -> DataFrame:
    """IJ-02, IJ-05: left's columns, then right's with an r_ before them, for each pair that overlaps or lies within a distance.

    Both sides have chrom, start_, end_ (and strand). A pair counts in the bin where the later of the two begins."""
    a, b, on = _meeting(left, right, bin_size, within)
    on &= F.col("bin") == _bin(F.greatest("_s", "r__s"), _at(F.col("place")), bin_size)
    if stranded:
        on &= F.col("strand").eqNullSafe(F.col("r_strand"))
    return a.join(b, on).select(*left.columns, *(f"r_{c}" for c in right.columns))


def matched(left: DataFrame, right: DataFrame, how: str, key: list[str], bin_size: int = BIN) -> DataFrame:
    """IJ-03 (left_anti), IJ-04 (left_semi): rows of left without, with, an overlap; key tells left's rows apart."""
    a, b, on = _meeting(left, right.select("chrom", "start_", "end_"), bin_size)
    # any bin decides, so no pairs are made
    found = a.join(b, on, "left_semi")
    if how == "left_semi":
        return found.select(*left.columns).dropDuplicates(key)
    return left.join(found.select(*key).distinct(), key, how)


def closest(left: DataFrame, right: DataFrame, key: list[str], *ties: str, bin_size: int = BIN) -> DataFrame:
    """IJ-22: of all that overlaps a row of left, the one with the least difference of starts and ends, then by `ties` (columns of right)."""
    pairs = overlap_pairs(left, right, bin_size)
    off = (F.abs(F.col("start_") - F.col("r_start_")) + F.abs(F.col("end_") - F.col("r_end_"))).cast("long")
    return pairs.groupBy(*key).agg(F.min(F.struct(off.alias("off"), *(F.col(f"r_{c}").alias(c) for c in ties))).alias("best")).select(*key, "best.*")


def annotate(left: DataFrame, right: DataFrame, key: list[str], *aggregates: Column, bin_size: int = BIN) -> DataFrame:
    """IJ-01, IJ-18: left's rows, each with aggregates over all that overlaps it (null where nothing does)."""
    found = overlap_pairs(left, right, bin_size).groupBy(*key).agg(*aggregates)
    return left.join(found, key, "left")


def annotate_sides(left: DataFrame, sides: dict[str, DataFrame], key: list[str], bin_size: int = BIN, stranded: bool = False) -> DataFrame:
    """IJ-01, IJ-18: left's rows, each with a column for each label: the array of all that overlaps it on that side (start_, end_, then the
    side's other columns but chrom), sorted; empty where nothing does. key tells left's rows apart.

    All sides pass one union, one join and one grouping, however many there are, and rows stay with their label whatever
    chromosomes a side has. An array is as long as what overlaps its row: for counts and sums use annotate()."""
    members = {label: ["start_", "end_", *(c for c in df.columns if c not in ("chrom", "start_", "end_"))] for label, df in sides.items()}
    other = [c for c in ("strand",) if stranded]
    tagged = [df.select("chrom", "start_", "end_", *other, *(F.struct(*members[x]).alias(f"_m{i}") for i, x in enumerate(sides) if x == label)) for label, df in sides.items()]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    pairs = overlap_pairs(left.select(*key, "chrom", "start_", "end_", *other), both, bin_size, stranded)
    found = pairs.groupBy(*key).agg(*(F.array_sort(F.collect_list(f"r__m{i}")).alias(f"_l{i}") for i in range(len(sides))))
    kinds = dict(found.dtypes)
    lists = {label: F.coalesce(F.col(f"_l{i}"), F.expr(f"cast(array() AS {kinds[f'_l{i}']})")) for i, label in enumerate(sides)}
    return left.join(found, key, "left").select(*left.columns, *(c.alias(label) for label, c in lists.items()))


def overlap_length() -> Column:
    """Of a pair from overlap_pairs."""
    return F.least("end_", "r_end_") - F.greatest("start_", "r_start_") + 1
