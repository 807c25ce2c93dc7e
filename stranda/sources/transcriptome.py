"""Files of a built transcriptome (SK-06, SK-07), tables of gene name aliases (SC-23) and rewritten VCF lines (SK-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text

# fixed values: colours of the strands, and the types that a file holds
COLOURS = {"-": "255,153,153", "+": "153,255,153"}
TYPES = ("gene", "transcript", "exon", "intron", "CDS", "three_prime_UTR", "five_prime_UTR")


def bed12_lines(features: DataFrame) -> DataFrame:
    """SK-06: (tx_id, value): a BED12 line for each transcript of built features. What is thick is the hull of its CDS, or all of it; blocks are its
    exons from left to right; one without exons has no blocks, and its length as their start. A transcript's exons meet in one row."""
    part = features.filter("kind = 'part' AND feature_type IN ('exon', 'CDS')")
    coding = F.col("feature_type") == "CDS"
    parts = part.groupBy(F.col("parent").alias("id")).agg(
        F.min(F.when(coding, F.col("start_"))).alias("thick"), F.max(F.when(coding, F.col("end_"))).alias("thick_end"), F.array_sort(F.collect_list(F.when(~coding, F.struct("start_", "end_")))).alias("b")
    )
    tx = features.filter("kind = 'transcript'").select("id", "chrom", "start_", "end_", "strand").join(parts, "id", "left")
    text_of = lambda c: c.cast("string")
    some = F.coalesce(F.size("b"), F.lit(0)) > 0
    listed = lambda f, none: F.when(some, F.array_join(F.transform("b", lambda x: text_of(f(x))), ",")).otherwise(none)
    fields = [
        F.col("chrom"), text_of(F.col("start_") - 1), text_of(F.col("end_")), F.col("id"), F.lit("."), F.coalesce("strand", F.lit(".")),
        text_of(F.coalesce("thick", "start_") - 1), text_of(F.coalesce("thick_end", "end_")), F.when(F.col("strand") == "-", COLOURS["-"]).otherwise(COLOURS["+"]),
        F.when(some, text_of(F.size("b"))).otherwise("0"), listed(lambda x: x["end_"] - x["start_"] + 1, "0"), listed(lambda x: x["start_"] - F.col("start_"), text_of(F.col("end_") - F.col("start_") + 1)),
    ]
    return tx.select(F.col("id").alias("tx_id"), F.concat_ws("\t", *fields).alias("value"))


def gff3_lines(features: DataFrame, types: tuple[str, ...] = TYPES, copied: tuple[str, ...] = (), source: str = "stranda", encode: bool = False) -> DataFrame:
    """SK-07: GFF3 lines of built features of some types: ID, Parent (but of genes), gene_name (of genes), then the attributes `copied` that a feature
    has; score and phase have columns of their own. encode: escape values (those that were decoded when read; others still are escaped)."""
    value = lambda c: text.escape(c) if encode else c
    attr = lambda a: F.try_element_at("attrs", F.lit(a))
    gene = F.col("kind") == "gene"
    info = [("ID", F.col("id")), ("Parent", F.when(~gene, F.col("parent"))), ("gene_name", F.when(gene, F.col("gene_name"))), *((a, attr(a)) for a in copied if a not in ("score", "phase"))]
    dot = lambda c: F.coalesce(c, F.lit("."))
    fields = [F.col("chrom"), F.lit(source), F.col("feature_type"), F.col("start_").cast("string"), F.col("end_").cast("string"), dot(attr("score")), dot(F.col("strand")), dot(attr("phase"))]
    return features.filter(F.col("feature_type").isin(list(types))).select(F.concat_ws("\t", *fields, F.concat_ws(";", *(F.concat(F.lit(f"{a}="), value(c)) for a, c in info))).alias("value"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """SC-23: (alias, name) of a tab-separated table with the columns symbol, alias_symbol and prev_symbol (names split at |). A symbol in use
    is no alias; of a name's several symbols the last row's counts, in a row that of prev_symbol as of alias_symbol."""
    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.select(F.trim("symbol").alias("name"), "alias_symbol", "prev_symbol", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    names = F.split(F.concat_ws("|", "alias_symbol", "prev_symbol"), r"\|")
    each = rows.select("name", "at", F.explode(names).alias("alias")).withColumn("alias", F.trim("alias")).filter("alias <> ''")
    last = each.groupBy("alias").agg(F.max_by("name", "at").alias("name"))
    return last.join(rows.select(F.col("name").alias("alias")).distinct(), "alias", "left_anti")


def id_to_info(lines: DataFrame, name: str, description: str | None = None) -> DataFrame:
    """SK-16: VCF lines (value) whose ids are in INFO under `name`, joined by commas; a record without an id stays as it is. The field is
    declared before the line of column names. No shuffle: lines keep their order."""
    f = F.split("value", "\t")
    info = F.concat(F.lit(f"{name}="), F.replace(F.get(f, 2), F.lit(";"), F.lit(",")))
    info = F.when(F.get(f, 7) == ".", info).otherwise(F.concat(F.get(f, 7), F.lit(";"), info))
    moved = F.array_join(F.concat(F.slice(f, 1, 2), F.array(F.lit(".")), F.slice(f, 4, 4), F.array(info), F.slice(f, 9, 1 << 30)), "\t")
    header = f'##INFO=<ID={name},Number=1,Type=String,Description="{description or name}">'
    out = F.when(F.col("value").startswith("#CHROM"), F.array(F.lit(header), F.col("value"))).when(F.col("value").startswith("#") | (F.get(f, 2) == ".") | (F.size(f) < 8), F.array("value")).otherwise(F.array(moved))
    return lines.select(F.explode(out).alias("value"))


def add_contigs(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """SK-16: VCF lines with a ##contig line for each chromosome of the reference (chrom, place, length) that has none, in its order, before the line of column
    names. What joins the lines is one row, as long as the reference has chromosomes."""
    known = lines.filter(F.col("value").startswith("##contig=<")).select(F.regexp_extract("value", "[<,]ID=([^,>]*)", 1).alias("chrom"))
    line = F.concat(F.lit("##contig=<ID="), F.col("chrom"), F.coalesce(F.concat(F.lit(",length="), F.col("length").cast("string")), F.lit("")), F.lit(">"))
    missing = reference.join(known, "chrom", "left_anti").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("new"))
    flagged = lines.select("value", F.col("value").startswith("#CHROM").alias("_head"))
    both = flagged.join(F.broadcast(missing.withColumn("_head", F.lit(True))), "_head", "left")
    return both.select(F.explode(F.concat(F.coalesce("new", F.expr("cast(array() AS array<string>)")), F.array("value"))).alias("value"))
