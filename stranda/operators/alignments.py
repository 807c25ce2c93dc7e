"""Alignments made of blocks (SK-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import text
from . import genome as genomes

# fixed values: the best quality of a base, and the mapping quality of a read without one
BEST, UNKNOWN = "~", 255


def built(reads: DataFrame, genome: DataFrame | None = None, size: int = genomes.CHUNK) -> DataFrame:
    """SK-14: (name, flag, chrom, start_, end_, mapq, cigar, seq, qual, tags), as sam_lines() writes them, of reads (name, chrom, strand, blocks: an array of
    start_, end_) and maybe seq, qual, mm (an array of off, alt: from 0, in the read), mapq, tags. Names are unique.

    A read spans its blocks, gaps between them are N. Where seq is null it is what the genome's chunks hold at the blocks, so that mm is all
    in which the read differs. The job fails on reads without blocks or strand, with blocks that overlap, or whose sequence, qualities or
    substitutions don't fit their blocks."""
    optional = {"seq": "string", "qual": "string", "mm": "array<struct<off: int, alt: string>>", "mapq": "int", "tags": "map<string,string>"}
    for name, kind in optional.items():
        if name not in reads.columns:
            reads = reads.withColumn(name, F.lit(None).cast(kind))
    blocks = F.array_sort(F.transform("blocks", lambda b: F.struct(b["start_"].alias("start_"), b["end_"].alias("end_"))))
    reads = reads.withColumn("blocks", blocks)
    if genome is not None:
        rows = reads.filter("seq IS NULL").select("name", "chrom", F.lit("+").alias("strand"), F.inline("blocks"))
        found = genomes.sequences(rows, genome, ["name"], "spliced", size).select("name", F.col("seq").alias("_seq"))
        reads = reads.join(found, "name", "left").withColumn("seq", F.coalesce("seq", "_seq"))
    bases = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["end_"] - b["start_"] + 1)
    whole = F.exists(F.sequence(F.lit(1), F.size("blocks")), lambda i: (F.get("blocks", i)["start_"] <= F.get("blocks", i - 1)["end_"]) | (F.get("blocks", i - 1)["start_"] > F.get("blocks", i - 1)["end_"]))
    some = F.coalesce("mm", F.expr("cast(array() AS array<struct<off: int, alt: string>>)"))
    wrong = F.exists(some, lambda m: (m["off"] < 0) | (m["off"] >= bases) | (F.length(m["alt"]) != 1))
    reads = _checked(reads, (F.size("blocks") > 0) & F.col("strand").isin("+", "-"), "no blocks or strand: ")
    reads = _checked(reads, ~F.coalesce(whole, F.lit(False)), "blocks overlap or are empty: ")
    reads = _checked(reads, (F.length("seq") == bases) & F.coalesce(F.length("qual") == bases, F.lit(True)) & ~wrong, "sequence does not fit its blocks: ")
    changed = F.aggregate(some, F.col("seq"), lambda s, m: F.concat(F.substr(s, F.lit(1), m["off"]), m["alt"], F.substr(s, m["off"] + 2)))
    return reads.select(
        "name", F.when(F.col("strand") == "-", 16).otherwise(0).alias("flag"), "chrom", F.get("blocks", 0)["start_"].alias("start_"), F.element_at("blocks", -1)["end_"].alias("end_"),
        F.coalesce("mapq", F.lit(UNKNOWN)).alias("mapq"), text.blocks_cigar(F.col("blocks")).alias("cigar"), changed.alias("seq"), F.coalesce("qual", F.repeat(F.lit(BEST), F.length("seq"))).alias("qual"),
        F.coalesce("tags", F.expr("cast(map() AS map<string,string>)")).alias("tags"),
    )


def _checked(reads: DataFrame, holds: Column, message: str) -> DataFrame:
    return reads.filter(F.assert_true(F.coalesce(holds, F.lit(False)), F.concat(F.lit(message), F.coalesce("name", F.lit("?")))).isNull())
