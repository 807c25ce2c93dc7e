"""The gene, transcript, exon model (TX) as tables, and coordinate mapping (SQ) along spliced transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def introns(exons: DataFrame) -> DataFrame:
    """TX-07: gaps between consecutive exons of a transcript, numbered from 1; empty ones are left out and not numbered."""
    order = Window.partitionBy("tx_id").orderBy("start_", *(["rnk"] if "rnk" in exons.columns else ["end_"]))
    gap = exons.select("tx_id", "chrom", "strand", (F.col("end_") + 1).alias("start_"), (F.lead("start_").over(order) - 1).alias("end_")).filter("start_ <= end_")
    return gap.withColumn("n", F.row_number().over(Window.partitionBy("tx_id").orderBy("start_")).cast("long"))


def ranked(exons: DataFrame) -> DataFrame:
    """TX-08: rank from the 5' end, and the spliced offset of each exon's 5' end (0-based)."""
    five = F.when(F.col("strand") == "-", -F.col("end_")).otherwise(F.col("start_"))
    order = Window.partitionBy("tx_id").orderBy(five)
    before = F.sum(F.col("end_") - F.col("start_") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return exons.withColumns({"rank": F.row_number().over(order).cast("long"), "offset": F.coalesce(before, F.lit(0)).cast("long")})


def last_bases(exons: DataFrame, width: int = 200, partial: bool = True) -> DataFrame:
    """SQ-18: blocks of the last `width` spliced bases of each transcript; all of a shorter one, or (without partial) none."""
    back = Window.partitionBy("tx_id").orderBy(F.when(F.col("strand") == "-", F.col("start_")).otherwise(-F.col("end_")))
    size = F.col("end_") - F.col("start_") + 1
    after = F.coalesce(F.sum(size).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not partial:
        exons = exons.withColumn("_size", F.sum(size).over(Window.partitionBy("tx_id"))).filter(F.col("_size") >= width)
    left = exons.withColumn("take", F.least(size, F.lit(width) - after)).filter("take > 0")
    minus = F.col("strand") == "-"
    return left.select("tx_id", "chrom", "strand", F.when(minus, F.col("start_")).otherwise(F.col("end_") - F.col("take") + 1).alias("start_"), F.when(minus, F.col("start_") + F.col("take") - 1).otherwise(F.col("end_")).alias("end_"))


def to_spliced(exons: DataFrame, points: DataFrame) -> DataFrame:
    """SQ-15 for points (tx_id, pos): 1-based position in the spliced transcript, null outside its exons."""
    r = ranked(exons).select("tx_id", "strand", "start_", "end_", "offset")
    inside = (F.col("pos") >= F.col("start_")) & (F.col("pos") <= F.col("end_"))
    at = F.when(F.col("strand") == "-", F.col("end_") - F.col("pos")).otherwise(F.col("pos") - F.col("start_"))
    found = points.join(r, "tx_id").filter(inside).groupBy("tx_id", "pos").agg(F.min(F.col("offset") + at + 1).alias("rel"))
    return points.join(found, ["tx_id", "pos"], "left")


def bed12(exons: DataFrame) -> DataFrame:
    """SK-06: one BED12 line for each transcript; blocks in genomic order, relative to its start."""
    agg = exons.groupBy("tx_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("start_").alias("s"), F.max("end_").alias("e"), F.array_sort(F.collect_list(F.struct("start_", "end_"))).alias("b"))
    join = lambda f: F.concat(F.array_join(F.transform("b", lambda x: f(x).cast("string")), ","), F.lit(","))
    start = (F.col("s") - 1).cast("string")
    return agg.select("tx_id", F.concat_ws("\t", "chrom", start, F.col("e").cast("string"), F.col("tx_id").cast("string"), F.lit("0"), F.coalesce("strand", F.lit(".")), start, F.col("e").cast("string"), F.lit("0,0,0"), F.size("b").cast("string"), join(lambda x: x["end_"] - x["start_"] + 1), join(lambda x: x["start_"] - F.col("s"))).alias("line"))


def to_genomic(exons: DataFrame, first: int, last: int) -> DataFrame:
    """SQ-16, SQ-17: blocks (tx_id, start_, end_) of the spliced positions first to last (1-based, from the 5' end)."""
    r = ranked(exons)
    size = F.col("end_") - F.col("start_") + 1
    lo, hi = F.greatest(F.lit(first) - F.col("offset"), F.lit(1)), F.least(F.lit(last) - F.col("offset"), size)
    minus = F.col("strand") == "-"
    cut = r.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
    return cut.select("tx_id", F.when(minus, F.col("end_") - F.col("hi") + 1).otherwise(F.col("start_") + F.col("lo") - 1).alias("start_"), F.when(minus, F.col("end_") - F.col("lo") + 1).otherwise(F.col("start_") + F.col("hi") - 1).alias("end_"))


def interval_to_spliced(exons: DataFrame, intervals: DataFrame) -> DataFrame:
    """SQ-15: (tx_id, q_start, q_end, rel_start, rel_end): spliced positions before an interval's ends; introns count nothing."""
    size = F.col("end_") - F.col("start_") + 1
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, size))
    minus = F.col("strand") == "-"
    before = F.when(minus, clamp(F.col("end_") - F.col("q_end"))).otherwise(clamp(F.col("q_start") - F.col("start_")))
    until = F.when(minus, clamp(F.col("end_") - F.col("q_start") + 1)).otherwise(clamp(F.col("q_end") - F.col("start_") + 1))
    both = intervals.join(exons, "tx_id")
    return both.groupBy("tx_id", "q_start", "q_end").agg((F.sum(before) + 1).cast("long").alias("rel_start"), F.sum(until).cast("long").alias("rel_end"))


def base_positions(exons: DataFrame) -> DataFrame:
    """SQ-16: (tx_id, positions, gaps): the genomic position of each spliced base from the 5' end, and how many bases lie between each two that follow
    one another. Exons of a transcript don't overlap; its arrays are as long as it is."""
    spans = exons.groupBy("tx_id").agg(F.min("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("start_", "end_"))).alias("b"))
    up = F.flatten(F.transform("b", lambda x: F.sequence(x["start_"], x["end_"])))
    out = spans.select("tx_id", F.when(F.col("strand") == "-", F.reverse(up)).otherwise(up).alias("positions"))
    gap = lambda x, i: F.abs(F.get("positions", i + 1) - x) - 1
    return out.withColumn("gaps", F.transform(F.slice("positions", F.lit(1), F.greatest(F.size("positions") - 1, F.lit(0))), gap))
