"""Reads (RD) and T>C conversions (TL): duplicates, sampling, per-base comparison with the reference, mismatch profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from . import islands
from .joins import overlap_pairs

SALT = 64


def downsample(reads: DataFrame, key: str, by: list[str], most: int) -> DataFrame:
    """RD-13: at most so many reads of each group, those of the least md5 of the key; first inside salted parts, then of what they leave."""
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    salted = Window.partitionBy(*by, F.pmod(F.xxhash64(key), F.lit(SALT))).orderBy(*order)
    some = reads.withColumn("_i", F.row_number().over(salted)).filter(F.col("_i") <= most)
    return some.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_i") <= most).drop("_i")


def deduplicate(reads: DataFrame, at: list[str], key: str) -> DataFrame:
    """RD-09: of reads alike in `at` (for PCR duplicates: chrom, start_, seq), the one with the least key. Pairs: mates.without_duplicates()."""
    kept = reads.groupBy(*at).agg(F.min(key).alias(key))
    return reads.join(kept.select(key), key, "left_semi")


def tag_label(tag: Column, values: list, drop_missing: bool = False, inverse: bool = False) -> Column:
    """RD-03: whether a tag filter drops a read: its tag is one of values (inverse: none of them); missing ones by drop_missing."""
    hit = tag.isin(values)
    return F.when(tag.isNull(), F.lit(drop_missing)).otherwise(~hit if inverse else hit)


def bases(reads: DataFrame, reference: Callable[[Column], Column], least_quality: int = 0) -> DataFrame:
    """RD-06, RD-10: a row for each aligned base of (uid, chrom, start_, cigar, seq, quals): chrom, pos, ref, alt, quality, offset in the read
    (from 0, clips counted), and the other columns.

    quals is an array of int. A deleted base has alt "-" and no quality, and is always kept."""
    each = reads.withColumn("op", F.explode(sq.cigar_blocks(F.col("start_"), F.col("cigar"))))
    spread = each.select("*", F.posexplode(F.sequence("op.start_", "op.end_")).alias("k", "pos"))
    at = (F.col("op.read_start") + F.col("k")).cast("int")
    deleted = F.col("op.op") == "D"
    out = spread.withColumns({"alt": F.when(deleted, "-").otherwise(F.substring("seq", at, F.lit(1))), "quality": F.when(~deleted, F.get("quals", at - 1)), "offset": F.when(~deleted, at - 1), "ref": reference(F.col("pos"))})
    return out.filter(F.col("quality").isNull() | (F.col("quality") >= least_quality)).drop("op", "k")


def mismatch_profile(found: DataFrame) -> DataFrame:
    """RD-16: (ref, alt, strand, n, prob): conditional probabilities of alt given ref and strand."""
    counts = found.filter("alt <> '-'").groupBy("ref", "alt", "strand").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("ref", "strand")))


def pileup_columns(found: DataFrame) -> DataFrame:
    """RD-17: one row for each covered position of bases (chrom, pos, ref, alt, strand): total and off (bases unlike ref, "-" too), and
    counts, an array of (alt, strand, n) of ten items at most for four bases and "-". A null ref is N."""
    each = found.withColumn("ref", F.coalesce("ref", F.lit("N"))).groupBy("chrom", "pos", "ref", "alt", "strand").agg(F.count("*").alias("n"))
    counts = F.array_sort(F.collect_list(F.struct("alt", "strand", "n")))
    off = F.sum(F.when(F.col("alt") != F.col("ref"), F.col("n")).otherwise(0))
    return each.groupBy("chrom", "pos", "ref").agg(F.sum("n").alias("total"), off.alias("off"), counts.alias("counts"))


def column_kind(min_cov: int = 10, max_mm_frac: float = 0.1) -> Column:
    """RD-17: of a pileup's column: lowcov unless covered more than min_cov times, snp if a larger share of it than max_mm_frac is unlike ref, else analysed."""
    return F.when(F.col("total") <= min_cov, "lowcov").when(F.col("off") / F.col("total") > max_mm_frac, "snp").otherwise("analysed")


def region_profiles(found: DataFrame, regions: DataFrame, key: str, min_cov: int = 10, max_mm_frac: float = 0.1, stranded: bool = True) -> DataFrame:
    """RD-17: of each region (key, chrom, start_, end_), by kind of column, the number of columns, and for analysed ones (ref, alt, strand, n) of the
    four bases; columns is not repeated: only one of a column's rows counts it. A position counts in each region that holds it."""
    at = pileup_columns(found).withColumns({"start_": F.col("pos"), "end_": F.col("pos"), "kind": column_kind(min_cov, max_mm_frac)})
    inside = overlap_pairs(at, regions.select(key, "chrom", "start_", "end_"))
    counts = F.when(F.col("kind") == "analysed", F.filter("counts", lambda c: c["alt"].isin("A", "C", "G", "T")))
    each = inside.select(F.col(f"r_{key}").alias(key), "kind", "ref", F.posexplode_outer(counts).alias("i", "c"))
    strand = F.when(F.col("c").isNotNull(), F.col("c.strand") if stranded else F.lit("+"))
    ref = F.when(F.col("c").isNotNull(), F.col("ref"))
    grouped = each.groupBy(key, "kind", ref.alias("ref"), F.col("c.alt").alias("alt"), strand.alias("strand"))
    return grouped.agg(F.coalesce(F.sum("c.n"), F.lit(0)).alias("n"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("columns"))


def sampled_regions(profiles: DataFrame, key: str, most: int) -> DataFrame:
    """RD-17, TL-05: the rows of region_profiles of regions in the order of the key's md5, as long as those before have fewer than `most` mismatches.

    The sums run inside 4096 ranges of md5; a row for each range carries over what the ranges before have."""
    off = F.sum(F.when(F.col("alt") != F.col("ref"), F.col("n")).otherwise(0))
    each = profiles.groupBy(key).agg(off.alias("_off")).withColumn("_md5", F.md5(F.col(key).cast("string")))
    each = each.withColumn("tile", F.substring("_md5", 1, 3))
    before = F.sum("_off").over(Window.partitionBy("tile").orderBy("_md5", key).rowsBetween(Window.unboundedPreceding, -1))
    each = islands.carry(each.withColumn("_in", F.coalesce(before, F.lit(0))), [], F.sum("_off"), F.sum, "_before")
    kept = each.filter(F.col("_in") + F.coalesce("_before", F.lit(0)) < most)
    return profiles.join(kept.select(key), key, "left_semi")


def profile_counts(profiles: DataFrame) -> DataFrame:
    """RD-16: region_profiles added up to (ref, alt, strand, n, prob)."""
    counts = profiles.filter("alt IS NOT NULL").groupBy("ref", "alt", "strand").agg(F.sum("n").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("ref", "strand")))


def mismatch_rates(profile: DataFrame) -> DataFrame:
    """RD-16: by strand, the number of bases and of mismatches of a profile, and the probability of a mismatch."""
    off = F.sum(F.when(F.col("alt") != F.col("ref"), F.col("n")).otherwise(0))
    return profile.groupBy("strand").agg(F.sum("n").alias("n"), off.alias("mismatches")).withColumn("prob", F.col("mismatches") / F.col("n"))


def pileup_at(found: DataFrame, positions: DataFrame) -> DataFrame:
    """RD-10 at positions (chrom, pos) alone: for each, total and counts by base (a map), zero and empty where nothing lies."""
    wanted = positions.select("chrom", "pos").distinct()
    each = found.join(wanted, ["chrom", "pos"], "left_semi").groupBy("chrom", "pos", "alt").agg(F.count("*").alias("n"))
    counts = each.groupBy("chrom", "pos").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("alt", "n")))).alias("counts"))
    empty = F.create_map().cast("map<string,bigint>")
    return wanted.join(counts, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("counts", empty).alias("counts"))


def tag_tc(found: DataFrame, key: list[str], reverse_strand: bool = False) -> DataFrame:
    """TL-01: of each read, xt convertible (T, or A on the other strand) and xc converted (to C, or G) bases; where found has their offset, xm (offsets of
    the converted ones, joined by commas) and yc (a colour that darkens with the share converted, null without any), too.

    The strand is the read's, turned for second reads, and once more for reverse_strand."""
    minus = (F.col("flag").bitwiseAND(F.lit(16)) != 0) != (F.col("flag").bitwiseAND(F.lit(128)) != 0)
    minus = ~minus if reverse_strand else minus
    source, target = F.when(minus, "A").otherwise("T"), F.when(minus, "G").otherwise("C")
    convertible = F.col("ref") == source
    converted = convertible & (F.col("alt") == target)
    counts = [F.count_if(convertible).alias("xt"), F.count_if(converted).alias("xc")]
    if "offset" not in found.columns:
        return found.groupBy(*key).agg(*counts)
    tagged = found.groupBy(*key).agg(*counts, F.array_sort(F.collect_list(F.when(converted, F.col("offset")))).alias("xm"))
    share = F.floor(F.lit(255) * (F.col("xc") / F.nullif("xt", F.lit(0))))
    colour = F.when(F.col("xc") > 0, F.concat((F.lit(255) - share).cast("string"), F.lit(",0,0")))
    return tagged.withColumns({"xm": F.array_join(F.transform("xm", lambda x: x.cast("string")), ","), "yc": colour})


def quantise(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """TL-06: the index of the equal-width bin, closed on the right; the minimum is in bin 0. One value: bin 0."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))
    at = F.ceil((F.col(column) - F.col("_lo")) / width) - 1
    return values.join(F.broadcast(ends)).withColumn("bin", F.when(F.col(column).isNotNull(), F.coalesce(F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)), F.lit(0))).cast("long")).drop("_lo", "_hi")
