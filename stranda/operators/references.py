"""Reference dictionaries (IJ-13 to IJ-16): tables (chrom, place from 0, length or null), a row for each chromosome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_scan(df: DataFrame) -> DataFrame:
    """IJ-14: chromosomes of intervals in the order of their names, each as long as its last position."""
    lengths = df.groupBy("chrom").agg(F.max("end_").cast("long").alias("length"))
    return _placed(lengths, "chrom").select("chrom", "place", "length")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """IJ-14: chromosomes that the header of a SAM (@SQ) or VCF (##contig) file declares, in its order; only its header lines are sorted."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.filter(F.col("value").startswith("@SQ\t") | F.col("value").startswith("##contig=<"))
    first = lambda sam, vcf: F.nullif(F.when(F.col("value").startswith("@"), F.regexp_extract("value", sam, 1)).otherwise(F.regexp_extract("value", vcf, 1)), F.lit(""))
    found = lines.select("block", "line", first(r"\tSN:([^\t]*)", r"[<,]ID=([^,>]*)").alias("chrom"), first(r"\tLN:(\d+)", r"[<,]length=(\d+)").cast("long").alias("length"))
    return _placed(found, "block", "line").select("chrom", "place", "length")


def merged(*dicts: DataFrame, check_order: bool = False, included: list[str] | None = None) -> DataFrame:
    """IJ-13: chromosomes that all dictionaries have, in the first's order, with the length that any of them knows. The job fails where
    two know different lengths and, with check_order, where the shared chromosomes of two are ordered otherwise. One aggregate for any
    number of dictionaries; the windows see a row for each chromosome."""
    rows = reduce(DataFrame.unionByName, (d.select(F.lit(i).alias("i"), "chrom", "place", "length") for i, d in enumerate(dicts)))
    if included is not None:
        rows = rows.filter(F.col("chrom").isin(included))
    shared = rows.groupBy("chrom").agg(F.min("length").alias("length"), F.max("length").alias("most"), F.transform(F.array_sort(F.collect_list(F.struct("i", "place"))), lambda x: x["place"]).alias("places"))
    shared = shared.filter(F.size("places") == len(dicts))
    shared = shared.filter(F.assert_true(F.coalesce(F.col("length") == F.col("most"), F.lit(True)), F.concat(F.lit("lengths differ: "), F.col("chrom"))).isNull())
    if check_order:
        before = F.lag("places").over(Window.orderBy(F.get("places", 0)))
        shared = shared.withColumn("falls", F.exists(F.zip_with(before, "places", lambda x, y: x > y), lambda x: x))
        shared = shared.filter(F.assert_true(~F.coalesce("falls", F.lit(False)), F.concat(F.lit("order differs: "), F.col("chrom"))).isNull())
    return _placed(shared.withColumn("own", F.get("places", 0)), "own").select("chrom", "place", "length")


def in_order(df: DataFrame, reference: DataFrame, reverse: bool = False) -> DataFrame:
    """IJ-16: df's rows on the reference's chromosomes, by their place, start and end (all falling with reverse); a range sort, ties as they come."""
    found = df.join(reference.select("chrom", F.col("place").alias("_place")), "chrom")
    keys = [F.col(c) for c in ("_place", "start_", "end_")]
    return found.orderBy(*(k.desc() if reverse else k.asc() for k in keys)).select(*df.columns)


def _placed(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
