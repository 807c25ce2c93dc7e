"""Readers (SC) and writers (SK) of tab-separated genomics text, as plain text scans with expressions; all intervals are 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: extension -> format (SC-21)
FORMATS = {"bed": "bed", "bedgraph": "bedgraph", "bg": "bedgraph", "gff3": "gff", "gtf": "gtf", "vcf": "vcf", "sam": "sam"}


#: what begins no row of BED and bedGraph
HEADER = r"^(#|(track|browser)(\s|$))"
# fixed values: what GFF3 writes in place of its separators (and of #, from which readers drop the rest), % first
ESCAPES = (("%", "%25"), ("#", "%23"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"))


def escape(c: Column) -> Column:
    """SK-07: an attribute's value without GFF3's separators."""
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(F.replace(c, F.lit(code.lower()), F.lit(plain)), F.lit(code), F.lit(plain))
    return c


def guess_format(path: str) -> str | None:
    """SC-21: by the extension, a compression's set aside."""
    parts = path.lower().rsplit("/", 1)[-1].split(".")
    return FORMATS.get(parts[-2] if parts[-1] in ("gz", "bgz", "bz2") and len(parts) > 1 else parts[-1])


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SC-01."""
    fmt = fmt or guess_format(path)
    readers = {"bed": read_bed, "bedgraph": read_bedgraph, "gff": read_gff, "gtf": lambda s, p: read_gff(s, p, gtf=True), "vcf": read_vcf, "sam": read_sam}
    if fmt not in readers:
        raise ValueError(f"unknown format of {path}")
    return readers[fmt](spark, path)


def _fields(lines: DataFrame, skip: str) -> DataFrame:
    """Fields of the column `value`."""
    return lines.filter((F.col("value") != "") & ~F.col("value").rlike(skip)).select(F.split("value", "\t").alias("f"))


def _f(i: int) -> Column:
    """Field i, null if absent or a dot."""
    return F.nullif(F.get("f", i), F.lit("."))


def _last_wins(pairs: Column) -> Column:
    """A map of (k, v) pairs; of equal keys the last counts."""
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))


def _ints(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("int"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed_rows(spark.read.text(path))


def bed_rows(lines: DataFrame) -> DataFrame:
    """SC-09: BED3 to BED12; absent columns are null, rows of start = end are kept as empty intervals."""
    df = _fields(lines, HEADER)
    return df.select(
        _f(0).alias("chrom"), (_f(1).cast("long") + 1).alias("start_"), _f(2).cast("long").alias("end_"), _f(5).alias("strand"), _f(3).alias("name"), _f(4).try_cast("int").alias("score"),
        (_f(6).cast("long") + 1).alias("thick_start"), _f(7).cast("long").alias("thick_end"), _f(8).alias("item_rgb"), _f(9).cast("int").alias("block_count"), _ints(_f(10)).alias("block_sizes"), _ints(_f(11)).alias("block_starts"),
    )


def read_bedgraph(spark: SparkSession, path: str, strand: str | None = None) -> DataFrame:
    return bedgraph_rows(spark.read.text(path), strand=strand)


def bedgraph_rows(lines: DataFrame, strand: str | None = None) -> DataFrame:
    """SC-08."""
    df = _fields(lines, HEADER)
    return df.select(_f(0).alias("chrom"), (_f(1).cast("long") + 1).alias("start_"), _f(2).cast("long").alias("end_"), F.lit(strand).cast("string").alias("strand"), _f(3).cast("double").alias("value"))


def parse_attributes(text: Column, gtf: bool = False) -> Column:
    """SC-20: map of GFF3 (k=v;...) or GTF (k "v"; ...) attributes; what follows # is dropped; GTF loses all quotes; the last of equal keys wins."""
    plain = F.split(F.regexp_replace(text, r"#.*$", ""), ";")
    sep = " " if gtf else "="
    parts = F.transform(F.filter(F.transform(plain, lambda x: F.trim(x) if gtf else F.ltrim(x)), lambda x: F.instr(x, sep) > 0), lambda x: F.split(x, sep, 2))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("k"), (F.trim(F.replace(p[1], F.lit('"'), F.lit(""))) if gtf else p[1]).alias("v")))
    return _last_wins(pairs)


def read_gff(spark: SparkSession, path: str, gtf: bool = False) -> DataFrame:
    return gff_rows(spark.read.text(path), gtf=gtf)


def gff_rows(lines: DataFrame, gtf: bool = False, types: list[str] | None = None, decode: bool = False) -> DataFrame:
    """SC-13: rows of the types named, or of all; decode turns GFF3's escapes in attributes back."""
    df = _fields(lines, "^#")
    if types is not None:
        df = df.filter(F.get("f", 2).isin(types))
    attrs = parse_attributes(F.get("f", 8), gtf)
    if decode:
        attrs = F.transform_values(attrs, lambda k, v: unescape(v))
    return df.select(_f(0).alias("chrom"), _f(3).cast("long").alias("start_"), _f(4).cast("long").alias("end_"), _f(6).alias("strand"), _f(1).alias("source"), _f(2).alias("feature_type"), _f(5).cast("double").alias("score"), _f(7).cast("int").alias("phase"), attrs.alias("attrs"))


def variant_location(pos: Column, ref: Column, alt: Column, info: Column) -> Column:
    """VC-02: (start_, end_, kind) by the first alternative: SNP or MNP, DEL (the bases lost), INS (the base before), SV (INFO/END)."""
    first = F.split(alt, ",")[0]
    here = lambda s, e, k: F.struct(s.cast("long").alias("start_"), e.cast("long").alias("end_"), F.lit(k).alias("kind"))
    end = F.coalesce(F.try_element_at(info, F.lit("END")).try_cast("long"), F.lit(-1))
    symbolic = F.startswith(first, F.lit("<")) & (first != "<*>")
    return (
        F.when(symbolic, here(pos, end, "SV"))
        .when(F.length(ref) > F.length(first), here(pos + 1, pos + F.length(ref) - 1, "DEL"))
        .when(F.length(ref) < F.length(first), here(pos, pos, "INS"))
        .otherwise(here(pos, pos + F.length(ref) - 1, "SNP"))
    )


def genotype_fields(format_: Column, sample: Column) -> Column:
    """VC-03: map of a sample's FORMAT fields; what is missing at the end is absent."""
    keys, values = F.split(format_, ":"), F.split(sample, ":")
    return _last_wins(F.transform(F.slice(keys, F.lit(1), F.size(values)), lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v"))))


def read_vcf(spark: SparkSession, path: str, only_pass: bool = True) -> DataFrame:
    return vcf_rows(spark.read.text(path), only_pass=only_pass)


def vcf_rows(lines: DataFrame, only_pass: bool = True, samples: list[int] | None = None, only_called: bool = False) -> DataFrame:
    """SC-12, VC-02 to VC-04: values stay strings; a flag in INFO is "true"; of equal keys the last counts. genotypes and fields (maps of FORMAT)
    are arrays in the samples' order, or that of the sample numbers given. only_called drops rows in which none of them has a call."""
    given = F.slice("f", 10, 1 << 30)
    if samples is not None:
        given = F.array(*(F.get(given, i) for i in samples))
    fields = F.transform(given, lambda x: genotype_fields(F.get("f", 8), x))
    info = _last_wins(F.transform(F.filter(F.split(_f(7), ";"), lambda x: x != ""), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), 1), F.lit("true")).alias("v"))))
    df = _fields(lines, "^#").select(_f(0).alias("chrom"), _f(1).cast("long").alias("pos"), _f(2).alias("id"), _f(3).alias("ref"), F.get("f", 4).alias("alt"), _f(5).alias("qual"), F.nullif(_f(6), F.lit("PASS")).alias("filter"), info.alias("info"), F.transform(given, lambda x: F.split(x, ":")[0]).alias("genotypes"), fields.alias("fields"))
    if only_called:
        df = df.filter(F.exists("genotypes", lambda g: F.coalesce(g.rlike(r"\d"), F.lit(False))))
    df = df.withColumn("at", variant_location(F.col("pos"), F.col("ref"), F.col("alt"), F.coalesce("info", F.create_map().cast("map<string,string>"))))
    df = df.select("*", "at.start_", "at.end_", "at.kind").drop("at")
    return df.filter(F.col("filter").isNull()) if only_pass else df


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_rows(spark.read.text(path))


def sam_rows(lines: DataFrame) -> DataFrame:
    """SC-18: alignments with tags as a map; end_ from the CIGAR, strand from the flag."""
    lengths = F.transform(F.regexp_extract_all(_f(5), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("long"))
    span = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    tags = _last_wins(F.transform(F.slice("f", 12, 1 << 30), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, 6, 1 << 30).alias("v"))))
    df = _fields(lines, "^@[A-Z][A-Z]\t")
    return df.select(_f(0).alias("name"), _f(1).cast("int").alias("flag"), F.nullif(_f(2), F.lit("*")).alias("chrom"), _f(3).cast("long").alias("start_"), (_f(3).cast("long") + span - 1).alias("end_"), F.when(_f(1).cast("int").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"), _f(4).cast("int").alias("mapq"), _f(5).alias("cigar"), F.get("f", 9).alias("seq"), F.get("f", 10).alias("qual"), tags.alias("tags"))


def bed_lines(df: DataFrame) -> DataFrame:
    """SK-05: one text column of BED6 lines from chrom, start_, end_, strand, name, score."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.select(F.concat_ws("\t", "chrom", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"), dot("name"), dot("score"), dot("strand")).alias("value"))


def gff_lines(df: DataFrame, *attributes: str) -> DataFrame:
    """SK-07: GFF3 lines of chrom, source, feature_type, start_, end_, score, strand, phase; attributes are columns, null ones left out, GFF3's separators in them
    escaped; an array's items are joined by commas."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in df.columns else F.lit(".")
    kinds = dict(df.dtypes)
    value = lambda a: F.array_join(F.transform(a, lambda x: escape(x.cast("string"))), ",") if kinds[a].startswith("array") else escape(F.col(a).cast("string"))
    info = F.concat_ws(";", *(F.concat(F.lit(f"{a}="), value(a)) for a in attributes))
    return df.select(F.concat_ws("\t", "chrom", dot("source"), "feature_type", F.col("start_").cast("string"), F.col("end_").cast("string"), dot("score"), dot("strand"), dot("phase"), info).alias("value"))


def tsv_lines(df: DataFrame, *columns: str) -> DataFrame:
    """SK-13: tab-separated lines, NA for null, arrays joined by commas."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "NA") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string")
    return df.select(F.concat_ws("\t", *(F.coalesce(text(c), F.lit("NA")) for c in columns)).alias("value"))


def sam_lines(df: DataFrame) -> DataFrame:
    """SK-14: SAM lines of name, flag, chrom, start_, mapq, cigar, seq, qual and the map of string tags (sorted by name)."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"]))
    fixed = F.array(star("name"), F.col("flag").cast("string"), star("chrom"), F.coalesce(F.col("start_"), F.lit(0)).cast("string"), F.col("mapq").cast("string"), star("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), star("qual"))
    return df.select(F.concat_ws("\t", F.concat(fixed, tags)).alias("value"))


def blocks_cigar(blocks: Column) -> Column:
    """SK-14: the CIGAR (M and N) of sorted blocks (start_, end_)."""
    part = lambda b, i: F.concat(F.when(i > 0, F.concat((b["start_"] - F.get(blocks, i - 1)["end_"] - 1).cast("string"), F.lit("N"))).otherwise(""), (b["end_"] - b["start_"] + 1).cast("string"), F.lit("M"))
    return F.array_join(F.transform(blocks, part), "")
