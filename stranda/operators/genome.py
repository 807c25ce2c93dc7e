"""Reference sequence as a table of chunks (chrom, chunk, seq): intervals fetch by an equi-join on chunks, windows need the next chunk alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement

CHUNK = 1 << 12  # a substring is counted from a chunk's begin, so larger ones cost time for each window


def chunked(segments: DataFrame, size: int = CHUNK) -> DataFrame:
    """SQ-13: chunks of segments (chrom, at: 0-based, seq) that don't overlap; what lies between segments is N, and no chunk is missing."""
    n = F.length("seq")
    each = segments.filter(n > 0).select("chrom", "at", "seq", F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + length(seq) - 1) div {size}"))).alias("chunk"))
    lo = F.greatest("at", F.col("chunk") * size)
    hi = F.least(F.col("at") + F.length("seq"), (F.col("chunk") + 1) * size)
    piece = F.struct((lo - F.col("chunk") * size).alias("at"), F.substring("seq", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("seq"))
    pieces = each.select("chrom", "chunk", piece.alias("p")).groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def filled(x: Column, i: Column) -> Column:
        before = F.get("p", i - 1)
        gap = x["at"] - F.when(i > 0, before["at"] + F.length(before["seq"])).otherwise(F.lit(0))
        return F.concat(F.repeat(F.lit("N"), gap.cast("int")), x["seq"])

    ends = segments.filter(n > 0).groupBy("chrom").agg(F.max(F.col("at") + n).alias("total"))
    every = ends.select("chrom", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {size}"))).alias("chunk"))
    wanted = F.least(F.lit(size), F.col("total") - F.col("chunk") * size).cast("int")
    seq = F.coalesce(F.array_join(F.transform("p", filled), ""), F.lit(""))
    return every.join(pieces, ["chrom", "chunk"], "left").select("chrom", "chunk", F.rpad(seq, wanted, F.lit("N")).alias("seq"))


def lengths(genome: DataFrame, size: int = CHUNK) -> DataFrame:
    """IJ-14: (chrom, length) of stored chunks."""
    return genome.groupBy("chrom").agg(F.max(F.col("chunk") * size + F.length("seq")).alias("length"))


def _first(offsets: dict[str, int] | None) -> Column:
    if not offsets:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("chrom")), F.lit(1))


def _touched(q: DataFrame, size: int) -> tuple[DataFrame, Column]:
    """Rows with _s and _e (0-based in the genome's stored bases), one for each chunk they touch (null: none), and what they have of that
    chunk's seq, once it is joined."""
    last = F.col("_e") - F.pmod("_e", F.lit(size))
    inside = F.when((F.col("_e") >= 0) & (F.col("_s") <= F.col("_e")), F.sequence(F.expr(f"greatest(_s, 0) div {size}"), (last / size).cast("long")))
    lo, hi = F.greatest("_s", F.col("chunk") * size), F.least("_e", (F.col("chunk") + 1) * size - 1)
    wanted = (hi - lo + 1).cast("int")
    piece = F.rpad(F.coalesce(F.substring("seq", (lo - F.col("chunk") * size + 1).cast("int"), wanted), F.lit("")), wanted, F.lit("N"))
    return q.withColumn("chunk", F.explode_outer(inside)), piece


def fetch(intervals: DataFrame, genome: DataFrame, key: list[str], size: int = CHUNK, offsets: dict[str, int] | None = None) -> DataFrame:
    """SQ-13: key and seq of each interval (key, chrom, start_, end_); N wherever the genome has nothing: before its first base, behind
    its last, in chromosomes it lacks. offsets: the position of a chromosome's first stored base (else 1).

    Rows of one key are one interval. Only the pieces meet: each interval has one row for each chunk it touches."""
    first = _first(offsets)
    q = intervals.select(*key, "chrom", (F.col("start_") - first).alias("_s"), (F.col("end_") - first).alias("_e")).dropDuplicates(key)
    each, piece = _touched(q, size)
    found = each.join(genome, ["chrom", "chunk"], "left").select(*key, "_s", "_e", F.struct("chunk", piece.alias("seq")).alias("p"))
    one = found.groupBy(*key).agg(F.min("_s").alias("_s"), F.min("_e").alias("_e"), F.array_sort(F.collect_list("p")).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.coalesce(x["seq"], F.lit(""))), "")
    n = F.greatest(F.lit(0), F.col("_e") - F.col("_s") + 1).cast("int")
    return one.select(*key, F.when(n == 0, "").otherwise(F.lpad(whole, n, F.lit("N"))).alias("seq"))


def sequences(features: DataFrame, genome: DataFrame, key: list[str], mode: str = "dna", size: int = CHUNK, boundaries: bool = False, offsets: dict[str, int] | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """SQ-12: key and seq of features (key, chrom, start_, end_, strand).

    dna: as on the + strand; rna: the reverse complement on -; spliced (of rows that are exons) and translated (of rows that are
    CDS parts): a key's rows joined in genomic order, then turned on -; boundaries puts * between them. kept: columns of the rows of
    which spliced and translated return each key's distinct values, as arrays."""
    if mode in ("dna", "rna"):
        seq = fetch(features, genome, key, size, offsets)
        if mode == "dna":
            return seq
        turned = seq.join(features.groupBy(*key).agg(F.min("strand").alias("_strand")), key)
        return turned.select(*key, F.when(F.col("_strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    if mode not in ("spliced", "translated"):
        raise ValueError(f"unknown mode {mode}")
    first = _first(offsets)
    parts = features.select(*key, *kept, "chrom", "start_", "end_", "strand", (F.col("start_") - first).alias("_s"), (F.col("end_") - first).alias("_e"))
    each, piece = _touched(parts, size)
    # the first piece of a row takes what lies before the genome
    opens = F.col("chunk").isNull() | (F.col("chunk") == F.expr(f"greatest(_s, 0) div {size}"))
    before = F.when(opens & F.col("chunk").isNotNull(), F.greatest(F.lit(0), -F.col("_s")).cast("int")).otherwise(0)
    text = F.concat(F.when(opens, "*" if boundaries else "").otherwise(""), F.repeat(F.lit("N"), before), F.coalesce(piece, F.lit("")))
    found = each.join(genome, ["chrom", "chunk"], "left").select(*key, *kept, "strand", F.struct("start_", "end_", "chrom", "strand", "chunk", text.alias("seq")).alias("p"))
    joined = found.groupBy(*key).agg(F.min("strand").alias("_strand"), F.array_sort(F.collect_list("p")).alias("p"), *(F.collect_set(F.struct(c)).alias(c) for c in kept))
    # of equal rows, one: pieces are sorted
    whole = F.array_join(F.transform("p", lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get("p", i - 1)), x["seq"])), "")
    whole = F.substr(whole, F.lit(2)) if boundaries else whole
    return joined.select(*key, F.when(F.col("_strand") == "-", reverse_complement(whole)).otherwise(whole).alias("seq"), *(F.col(c)[c].alias(c) for c in kept))


def windows(genome: DataFrame, width: int, step: int, padding: bool = False, region: tuple[str, int, int] | None = None, size: int = CHUNK) -> DataFrame:
    """SC-06, SQ-09: (chrom, start_, end_, seq) of every window of a region (chrom, first, last) or of all chromosomes.

    Windows begin each `step` bases; the last may be cut and is filled up with N, if it has a base that no window before has, or
    any when step exceeds width. padding puts half a width of N at both ends. Each chunk makes the windows that begin in it, and
    has the first bases of the next one for those that reach on."""
    if not 0 < width <= size or step < 1:
        raise ValueError("width must be between 1 and the chunk size, step at least 1")
    pad = width // 2 if padding else 0
    ends = lengths(genome, size)
    if region:
        chrom, first, last = region
        ends = ends.filter(F.col("chrom") == chrom).withColumns({"lo": F.lit(max(1, first)).cast("long"), "hi": F.least(F.lit(last), "length").cast("long")})
        genome = genome.filter((F.col("chrom") == chrom) & F.col("chunk").between((max(1, first) - 1) // size, (last - 1) // size))
    else:
        ends = ends.withColumns({"lo": F.lit(1).cast("long"), "hi": F.col("length").cast("long")})
    n = F.col("hi") - F.col("lo") + 1 + 2 * pad
    full = F.greatest(F.lit(0), F.floor((n - width) / step) + 1)
    rest = F.when(n < width, F.lit(0)).otherwise(full * step)
    # behind the last full window: something is left, and the next window begins before the end
    more = (rest < n) & (F.when(n < width, n > 0).otherwise((full - 1) * step + width < n))
    ends = ends.filter("lo <= hi").select("chrom", "lo", "hi", (full + F.when(more, 1).otherwise(0)).cast("long").alias("count"))
    head = genome.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.substring("seq", 1, width).alias("next"))
    at = genome.join(head, ["chrom", "chunk"], "left").join(ends, "chrom").withColumn("zero", F.col("lo") - pad)
    begin = F.when(F.col("chunk") == F.expr(f"(lo - 1) div {size}"), F.lit(0)).otherwise(F.ceil((F.col("chunk") * size + 1 - F.col("zero")) / step))
    stop = F.when(F.col("chunk") == F.expr(f"(hi - 1) div {size}"), F.col("count") - 1).otherwise(F.floor(((F.col("chunk") + 1) * size - F.col("zero")) / step))
    at = at.withColumns({"begin": begin, "stop": F.least(stop, F.col("count") - 1)}).filter("begin <= stop")
    each = at.withColumn("k", F.explode(F.sequence("begin", "stop"))).withColumn("start_", F.col("zero") + F.col("k") * step)
    a, b = F.greatest("start_", "lo"), F.least(F.col("start_") + width - 1, F.col("hi"))
    have = F.greatest(F.lit(0), b - a + 1)
    core = F.substring(F.concat("seq", F.coalesce("next", F.lit(""))), (a - F.col("chunk") * size).cast("int"), have.cast("int"))
    left = F.least(F.lit(width), F.greatest(F.lit(0), F.col("lo") - F.col("start_"))).cast("int")
    seq = F.rpad(F.concat(F.repeat(F.lit("N"), left), core), width, "N")
    return each.select("chrom", "start_", (F.col("start_") + width - 1).alias("end_"), seq.alias("seq"))
