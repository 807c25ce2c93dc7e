"""Read pairs (RD-08) by name, in the order of the scan, and their PCR duplicates (RD-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ2, REVERSE = 128, 16


def pairs(reads: DataFrame, order: list[str]) -> DataFrame:
    """RD-08: reads (name, chrom, start_, end_, flag, and any others) as pairs: name, kind, chrom, start_, end_, strand, r1, r2.

    Reads of one name pair up as they come in `order` (which tells all reads apart, such as chrom, start_, uid): the first with the second,
    the third with the fourth. kind is pair, orphan (one read is left over) or discordant (mates on different chromosomes; their
    hull is null). The strand is that of the read that comes first; r1 and r2 are the whole reads by their flags, so one is null in
    an orphan. A read without a name is an orphan. One shuffle, by name."""
    row = F.struct(*reads.columns)
    plain = reads.select("name", row.alias("r"), F.struct(*order).alias("at"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("at")) - 1
    named = plain.filter("name IS NOT NULL").withColumn("n", place)
    both = named.groupBy("name", F.floor(F.col("n") / 2).alias("pair")).agg(F.min_by("r", "n").alias("a"), F.count("*").alias("k"), F.max_by("r", "n").alias("b"), F.min("at").alias("at")).drop("pair")
    alone = plain.filter("name IS NULL").select("name", F.col("r").alias("a"), F.lit(1).cast("long").alias("k"), F.col("r").alias("b"), "at")
    every = both.unionByName(alone)
    second = F.col("a.flag").bitwiseAND(F.lit(READ2)) != 0
    mate = F.when(F.col("k") == 2, F.col("b"))
    apart = (F.col("k") == 2) & ~F.col("a.chrom").eqNullSafe(F.col("b.chrom"))
    here = lambda c: F.when(~apart, c)
    return every.select(
        "name",
        F.when(F.col("k") == 1, "orphan").when(apart, "discordant").otherwise("pair").alias("kind"),
        here(F.col("a.chrom")).alias("chrom"), here(F.least("a.start_", "b.start_")).alias("start_"), here(F.greatest("a.end_", "b.end_")).alias("end_"),
        here(F.when(F.col("a.flag").bitwiseAND(F.lit(REVERSE)) != 0, "-").otherwise("+")).alias("strand"),
        F.when(second, mate).otherwise(F.col("a")).alias("r1"), F.when(second, F.col("a")).otherwise(mate).alias("r2"), "at",
    )


def _sequence(read: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{read}.seq"), F.lit("*")), F.lit(""))


def without_duplicates(found: DataFrame) -> DataFrame:
    """RD-09: of pairs() with equal chromosome, start and sequences of both reads, the one that comes first in the scan. Pairs without a
    sequence, and discordant ones, all stay. A group's rows are reduced before the shuffle."""
    told = F.concat(_sequence("r1"), _sequence("r2")) != ""
    free = F.col("kind") == "discordant"
    columns = [F.col(c) for c in found.columns]
    keyed = found.filter(told & ~free).groupBy("chrom", "start_", _sequence("r1").alias("s1"), _sequence("r2").alias("s2")).agg(F.min_by(F.struct(*columns), "at").alias("x")).select("x.*")
    return keyed.unionByName(found.filter(~told | free))
