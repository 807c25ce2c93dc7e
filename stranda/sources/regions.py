"""Regions (SC-03) of located rows, tab-separated tables with any coordinate columns (SC-07), and stored tables whose files a region prunes."""

from __future__ import annotations

import re
from collections.abc import Collection
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import level, widths

#: bins of stored tables: a chromosome of 250 million bases has some 240 of the first level
STORED_BIN = 1 << 20


class Region(NamedTuple):
    """A chromosome, or a part of it: null ends are open."""

    chrom: str | None = None
    start: int | None = None
    end: int | None = None

    @classmethod
    def of(cls, text: str | Region | None) -> Region:
        """From chr1, chr1:100, chr1:100-200 (commas as thousands marks); none is everywhere."""
        if text is None or isinstance(text, Region):
            return text or cls()
        m = re.fullmatch(r"([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?(?: \([+-]\))?", text.strip())
        if not m:
            raise ValueError(f"no region: {text}")
        start, end = (int(x.replace(",", "")) if x else None for x in m.groups()[1:])
        return cls(m[1], start, start if start is not None and end is None else end)

    def known(self, chroms: Collection[str] | None) -> Region:
        if chroms is not None and self.chrom is not None and self.chrom not in chroms:
            raise ValueError(f"{self.chrom} is none of the chromosomes")
        return self

    def overlaps(self) -> Column:
        """Whether a row (chrom, start_, end_) overlaps it."""
        out = F.lit(True) if self.chrom is None else F.col("chrom") == self.chrom
        if self.end is not None:
            out &= F.col("start_") <= self.end
        if self.start is not None:
            out &= F.col("end_") >= self.start
        return out & (F.col("start_") <= F.col("end_"))


def in_region(df: DataFrame, region: str | Region | None, chroms: Collection[str] | None = None) -> DataFrame:
    """SC-03: rows that overlap a region; a chromosome that is none of chroms (if given) is an error."""
    at = Region.of(region).known(chroms)
    return df if at == Region() else df.filter(at.overlaps())


def tsv_rows(lines: DataFrame, columns: tuple[int, int, int] = (0, 1, 2), shift: tuple[int, int] = (0, 0), region: str | Region | None = None, alias: dict[str, str] | None = None, comment: str = "#") -> DataFrame:
    """SC-07: (chrom, start_, end_, fields) of tab-separated lines (column value). columns: the places of chromosome, start and end;
    shift is added to start and end, so (1, 0) reads 0-based half-open ones; alias renames chromosomes, and the region is of the new names.

    Lines without numbers there are left out, as are comments and empty lines."""
    fields = F.split("value", "\t")
    df = lines.filter((F.col("value") != "") & ~F.startswith("value", F.lit(comment))).select(fields.alias("fields"))
    chrom = F.get("fields", columns[0])
    if alias:
        chrom = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in alias.items() for x in kv)), chrom), chrom)
    number = lambda i: F.get("fields", columns[i]).try_cast("long") + shift[i - 1]
    df = df.select(chrom.alias("chrom"), number(1).alias("start_"), number(2).alias("end_"), "fields").filter("start_ IS NOT NULL AND end_ IS NOT NULL")
    return in_region(df, region)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    """SC-07: tsv_rows() of files, compressed or not."""
    return tsv_rows(spark.read.text(path), **options)


def store(df: DataFrame, path: str, bin_size: int = STORED_BIN, mode: str = "errorifexists") -> None:
    """Parquet files by chromosome, level of length and bin of the start: each row once, with start_ sorted in each file.

    AQE splits a bin that holds too much into several files."""
    width = F.element_at(F.array(*map(F.lit, widths(bin_size))), F.col("level") + 1)
    placed = df.withColumn("level", level(F.col("start_"), F.col("end_"), bin_size)).withColumn("bin", F.floor(F.col("start_") / width))
    placed.withColumn("part", F.col("chrom")).hint("rebalance", F.col("part"), F.col("level"), F.col("bin")).sortWithinPartitions("part", "level", "bin", "start_").write.partitionBy("part", "level", "bin").mode(mode).parquet(path)


def scan(spark: SparkSession, path: str, region: str | Region | None = None, bin_size: int = STORED_BIN) -> DataFrame:
    """SC-07: the rows of a stored table that overlap a region. Of each level, only the bins that the region touches, and the one before
    them, in which what reaches into it begins, are read."""
    df, at = spark.read.option("mergeSchema", False).parquet(path), Region.of(region)
    if at.chrom is not None:
        df = df.filter(F.col("part") == at.chrom)
    if at.start is not None or at.end is not None:
        touched = F.lit(False)
        for i, w in enumerate(widths(bin_size)):
            bins = F.lit(True)
            if at.start is not None and i < len(widths(bin_size)) - 1:
                bins &= F.col("bin") >= at.start // w - 1
            if at.end is not None:
                bins &= F.col("bin") <= at.end // w
            touched |= (F.col("level") == i) & bins
        df = df.filter(touched)
    return in_region(df, at).drop("part", "level", "bin")
