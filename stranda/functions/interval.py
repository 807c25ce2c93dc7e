"""Interval algebra (IV) as Column functions. Coordinates are 1-based and both ends belong to the interval."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INT = 2**31 - 1  # fixed value: an open end


class Interval(NamedTuple):
    """Columns of one interval; strand may be null."""

    chrom: Column
    start: Column
    end: Column
    strand: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Interval:
        """From columns chrom, start_, end_, strand."""
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("chrom", "start_", "end_", "strand")))


def is_empty(a: Interval) -> Column:
    """IV-04."""
    return a.start > a.end


def is_unbounded(a: Interval) -> Column:
    """IV-05."""
    return a.chrom.isNull() & (a.start == 0) & (a.end == MAX_INT) & a.strand.isNull()


def length(a: Interval) -> Column:
    """IV-03: 0 if empty, MAX_INT if an end is open."""
    return F.when(is_empty(a), 0).when((a.start == 0) | (a.end == MAX_INT), MAX_INT).otherwise(a.end - a.start + 1).cast("long")


def cs_match(a: Interval, b: Interval, strand_specific: bool = False) -> Column:
    """IV-06: chromosomes agree (null agrees with all); strands too if asked, null with null alone."""
    same = a.chrom.isNull() | b.chrom.isNull() | (a.chrom == b.chrom)
    return same & a.strand.eqNullSafe(b.strand) if strand_specific else same


def overlaps(a: Interval, b: Interval, strand_specific: bool = False) -> Column:
    """IV-11."""
    plain = ~is_empty(a) & ~is_empty(b) & cs_match(a, b, strand_specific) & (a.start <= b.end) & (b.start <= a.end)
    return is_unbounded(a) | is_unbounded(b) | plain


def overlap(a: Interval, b: Interval, strand_specific: bool = False) -> Column:
    """IV-12: number of shared positions, as long."""
    return F.when(overlaps(a, b, strand_specific), F.greatest(F.lit(0), F.least(a.end, b.end) - F.greatest(a.start, b.start) + 1)).otherwise(0).cast("long")


def envelops(a: Interval, b: Interval, strand_specific: bool = False) -> Column:
    """IV-10: b lies within a."""
    return is_unbounded(a) | (cs_match(a, b, strand_specific) & (a.start <= b.start) & (a.end >= b.end))


def is_adjacent(a: Interval, b: Interval, strand_specific: bool = False) -> Column:
    """IV-15: they touch without overlapping."""
    return cs_match(a, b, strand_specific) & ((a.end + 1 == b.start) | (b.end + 1 == a.start))


def distance(a: Interval, b: Interval, strand_specific: bool = False) -> Column:
    """IV-19: 0 if they overlap, 1 if b follows at once, negative if b lies before a, null across chromosomes."""
    return F.when(~cs_match(a, b, strand_specific), F.lit(None)).when(overlaps(a, b, strand_specific), 0).when(b.start > a.end, b.start - a.end).otherwise(b.end - a.start).cast("long")


def upstream(a: Interval, width: int) -> tuple[Column, Column]:
    """IV-16: (start, end) of the flank before the interval in its own direction; null without a strand."""
    start = F.when(a.strand == "+", a.start - width).when(a.strand == "-", a.end + 1)
    return start, start + (width - 1)


def downstream(a: Interval, width: int) -> tuple[Column, Column]:
    """IV-16."""
    start = F.when(a.strand == "+", a.end + 1).when(a.strand == "-", a.start - width)
    return start, start + (width - 1)


def extended(a: Interval, width: int) -> tuple[Column, Column]:
    """IV-17."""
    return a.start - width, a.end + width


def subtract(a: Interval, b: Interval) -> Column:
    """IV-14: array of the 0 to 2 pieces (start, end) of a that b leaves; a itself if they don't overlap."""
    piece = lambda s, e: F.struct(s.cast("long").alias("start_"), e.cast("long").alias("end_"))
    both = F.filter(F.array(piece(a.start, F.least(a.end, b.start - 1)), piece(F.greatest(a.start, b.end + 1), a.end)), lambda p: p["start_"] <= p["end_"])
    return F.when(overlaps(a, b), both).otherwise(F.array(piece(a.start, a.end)))


def pieces(a: Interval, width: int) -> Column:
    """IV-18: array of (start, end) of at most width positions; none if empty."""
    whole = F.transform(F.sequence(a.start, a.end, F.lit(width).cast("long")), lambda s: F.struct(s.alias("start_"), F.least(s + (width - 1), a.end).alias("end_")))
    return F.when(a.start <= a.end, whole)


def parse(text: Column) -> Column:
    """IV-02: chrom:start-end with an optional (strand), commas allowed; null fields if it is something else."""
    pattern = r"^([\w.\-]+):([\d,]+)-([\d,]+)(?:\s*\(([+-])\))?$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    number = lambda i: F.regexp_replace(part(i), ",", "").cast("long")
    return F.struct(part(1).alias("chrom"), number(2).alias("start_"), number(3).alias("end_"), part(4).alias("strand"))


def render(a: Interval) -> Column:
    """SK-08."""
    return F.concat(a.chrom, F.lit(":"), a.start.cast("string"), F.lit("-"), a.end.cast("string"), F.coalesce(F.concat(F.lit(" ("), a.strand, F.lit(")")), F.lit("")))


def before(a: Interval, b: Interval) -> Column:
    """IV-07: a < b by start, then end; null across chromosomes."""
    return F.when(cs_match(a, b), (a.start < b.start) | ((a.start == b.start) & (a.end < b.end)))


def same_start(a: Interval, b: Interval) -> Column:
    """IV-08."""
    return cs_match(a, b) & (a.start == b.start)


def same_end(a: Interval, b: Interval) -> Column:
    """IV-08."""
    return cs_match(a, b) & (a.end == b.end)


def hull(a: Interval, b: Interval) -> Column:
    """IV-13: (start_, end_) around both; null across chromosomes."""
    return F.when(cs_match(a, b), F.struct(F.least(a.start, b.start).cast("long").alias("start_"), F.greatest(a.end, b.end).cast("long").alias("end_")))


def positions(a: Interval) -> Column:
    """IV-21: array of all positions, empty if there are none."""
    return F.when(a.start <= a.end, F.sequence(a.start.cast("long"), a.end.cast("long"))).otherwise(F.expr("cast(array() AS array<bigint>)"))


def toggle_chr(chrom: Column) -> Column:
    """IV-22: with the prefix chr where it lacks, without where it is there."""
    return F.when(chrom.startswith("chr"), F.substr(chrom, F.lit(4))).otherwise(F.concat(F.lit("chr"), chrom))


def blocks_inside(blocks: Column, a: Interval, least: float = 0.95) -> Column:
    """IV-23: whether so large a share of the blocks (array of start_, end_) lies in an interval."""
    shared = F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.greatest(F.lit(0), F.least(b["end_"], a.end) - F.greatest(b["start_"], a.start) + 1))
    size = F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + b["end_"] - b["start_"] + 1)
    return shared >= least * size
