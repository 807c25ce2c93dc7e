"""Amplicons (TL-04): intervals of interest, extended and merged to the pieces of a small padded reference, and their places on these pieces."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import wrap
from . import genome as reference
from .islands import grouped


class Amplicons(NamedTuple):
    """pieces: amplicon, chrom, start_, end_ (as merged, not cut at the chromosome's end), n intervals, seq (padded), length, md5.
    mapped: the columns of the intervals, amplicon, rel_start and rel_end (1-based, on the padded piece)."""

    pieces: DataFrame
    mapped: DataFrame


def build(intervals: DataFrame, genome: DataFrame, padding: int = 100, extension: int = 100, size: int = reference.CHUNK) -> Amplicons:
    """TL-04: pieces of intervals (chrom, start_, end_, name; more columns are kept), extended on both sides, not before position 1; those that
    share a base then are one piece. Its name joins by "+" what was merged, each `name_chrom_start_end`, by extended start, end and name;
    equal ones count once. The sequence ends with the chromosome and has N only for padding and where the genome has none.

    Intervals on chromosomes that the genome lacks, empty ones and those without coordinates are left out; a null name is "None".
    A piece's name is as long as the intervals merged into it are many: the format asks for it."""
    known = reference.lengths(genome, size)
    label = F.concat_ws("_", F.coalesce("name", F.lit("None")), "chrom", F.col("start_").cast("string"), F.col("end_").cast("string"))
    kept = intervals.filter("start_ <= end_").join(known.select("chrom"), "chrom", "left_semi")
    begin, until = F.greatest(F.col("start_") - extension, F.lit(1)), F.col("end_") + extension
    row = F.struct(*(F.col(c) for c in intervals.columns))
    each = kept.select("chrom", begin.alias("start_"), until.alias("end_"), label.alias("label"), row.alias("row"))
    inside = grouped(each, ["chrom"], ["label"])
    parts = F.array_sort(F.collect_set(F.struct("start_", "end_", "label")))
    pieces = inside.groupBy("chrom", "group_start", "group_end").agg(parts.alias("parts"), F.count("*").alias("n"))
    pieces = pieces.select(F.array_join("parts.label", "+").alias("amplicon"), "chrom", F.col("group_start").alias("start_"), F.col("group_end").alias("end_"), "n")
    cut = pieces.join(known, "chrom").select("chrom", "start_", F.col("start_").alias("at"), F.least("end_", "length").alias("end_"))
    seq = reference.fetch(cut, genome, ["chrom", "at"], size).withColumnRenamed("at", "start_")
    pad = F.lit("N" * padding)
    pieces = pieces.join(seq, ["chrom", "start_"]).withColumn("seq", F.concat(pad, "seq", pad))
    at = padding + F.col("row.start_") - F.col("start_") + 1
    names = pieces.select("amplicon", "chrom", "start_")
    mapped = inside.select("row", "chrom", F.col("group_start").alias("start_")).join(names, ["chrom", "start_"])
    mapped = mapped.select("row.*", "amplicon", at.alias("rel_start"), (at + F.col("row.end_") - F.col("row.start_")).alias("rel_end"))
    return Amplicons(pieces.select("amplicon", "chrom", "start_", "end_", "n", "seq", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("md5")), mapped)


def _dot(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(".")) if column in df.columns else F.lit(".")


def bed_lines(mapped: DataFrame) -> DataFrame:
    """BED6 lines of the intervals on their pieces, to be sorted by whoever writes them."""
    return mapped.select(F.concat_ws("\t", "amplicon", (F.col("rel_start") - 1).cast("string"), F.col("rel_end").cast("string"), F.coalesce("name", F.lit("None")), _dot(mapped, "score"), _dot(mapped, "strand")).alias("value"))


def gff_lines(mapped: DataFrame, source: str = "stranda") -> DataFrame:
    """GFF3 lines: each interval is a transcript on its piece."""
    name = F.concat(F.lit("gene_name="), F.coalesce("name", F.lit("None")))
    return mapped.select(F.concat_ws("\t", "amplicon", F.lit(source), F.lit("transcript"), F.col("rel_start").cast("string"), F.col("rel_end").cast("string"), _dot(mapped, "score"), _dot(mapped, "strand"), F.lit("0"), name).alias("value"))


def fasta_lines(pieces: DataFrame, width: int = 80) -> DataFrame:
    """A FASTA record for each piece, its lines in one value."""
    return pieces.select(F.concat(F.lit(">"), "amplicon", F.lit("\n"), wrap(F.col("seq"), width)).alias("value"))


def size_lines(pieces: DataFrame) -> DataFrame:
    """The lines of a table of chromosome sizes."""
    return pieces.select(F.concat_ws("\t", "amplicon", F.col("length").cast("string")).alias("value"))


def dict_lines(pieces: DataFrame, uri: str) -> DataFrame:
    """The lines of a sequence dictionary; uri is where the FASTA file is."""
    return pieces.select(F.concat(F.lit("@SQ\tSN:"), "amplicon", F.lit("\tLN:"), F.col("length").cast("string"), F.lit("\tM5:"), "md5", F.lit(f"\tUR:{uri}")).alias("value"))


def summary(made: Amplicons) -> DataFrame:
    """One row: parsed_intervals, written_amplicons and mean_amplicon_length, in which a piece counts once for each of its intervals and which is
    then divided by the number of pieces; null without any."""
    return made.pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parsed_intervals"), F.count("*").alias("written_amplicons"), (F.sum(F.col("n") * F.col("length")) / F.nullif(F.count("*"), F.lit(0))).alias("mean_amplicon_length"))
