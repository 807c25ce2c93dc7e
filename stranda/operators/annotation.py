"""Building transcriptomes (TX) from GFF rows: genes, transcripts and their parts, with the reason why each row was left out."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut


class Flavour(NamedTuple):
    """TX-14: what a source calls things.

    types: feature type -> gene, transcript or the name of a part; None, or an absent type, is left out and logged. The other fields name
    attributes: without gene_id, all genes are made of their transcripts; without transcript_gene, each transcript has a gene of its
    own; without part_transcript, transcripts have no parts. Made genes have the attributes `copied` of their first transcript."""

    types: dict[str, str | None]
    gene_id: str | None
    transcript_id: str
    transcript_gene: str | None
    part_transcript: str | None
    gene_name: str
    copied: tuple[str, ...] = ()

    def of(self, *levels: str) -> dict[str, str]:
        """The types that are genes, transcripts, or (levels: part) anything else."""
        return {k: v for k, v in self.types.items() if v is not None and (v if v in ("gene", "transcript") else "part") in levels}


# fixed values: what annotation sources call things
_GENES = ("gene", "ncRNA_gene")
_TRANSCRIPTS = ("transcript", "mRNA", "ncRNA", "lnc_RNA", "pseudogenic_transcript", "pre_miRNA", "rRNA", "snRNA", "snoRNA", "tRNA", "miRNA")
_PARTS = {"exon": "exon", "intron": "intron", "CDS": "CDS", "three_prime_UTR": "three_prime_UTR", "3UTR": "three_prime_UTR", "UTR3": "three_prime_UTR", "five_prime_UTR": "five_prime_UTR", "5UTR": "five_prime_UTR", "UTR5": "five_prime_UTR"}
TYPES = dict.fromkeys(_GENES, "gene") | dict.fromkeys(_TRANSCRIPTS, "transcript") | _PARTS
_BY_ID = ("ID", "ID", "Parent", "Parent")
_BY_NAME = ("gene_id", "transcript_id", "gene_id", "transcript_id")
FLAVOURS = {
    ("gencode", "gff"): Flavour(TYPES, *_BY_ID, "gene_name", ("source", "gene_type")),
    ("gencode", "gtf"): Flavour(TYPES, *_BY_NAME, "gene_name", ("source", "gene_type")),
    ("ensembl", "gff"): Flavour(TYPES | {"pseudogene": "gene"}, *_BY_ID, "Name", ("source", "gene_type")),
    ("flybase", "gtf"): Flavour(TYPES | {"pseudogene": "transcript"}, *_BY_NAME, "gene_symbol", ("source", "gene_type")),
    ("wormbase", "gff"): Flavour(TYPES | {"pseudogenic_transcript": None, "snRNA": None}, *_BY_ID, "Name", ("source", "biotype", "so_term_name")),
    ("ucsc", "gtf"): Flavour(TYPES, None, *_BY_NAME[1:], "gene_name", ("source", "gene_type")),
    ("chess", "gff"): Flavour(TYPES, None, *_BY_ID[1:], "gene_name", ("source", "gene_type")),
    ("chess", "gtf"): Flavour(TYPES, None, *_BY_NAME[1:], "gene_name", ("source", "gene_type")),
    ("mirgenedb", "gff"): Flavour({"pre_miRNA": "transcript", "miRNA": "transcript"}, None, "ID", None, None, "Alias", ("source", "Alias")),
    ("mirbase", "gff"): Flavour({"miRNA_primary_transcript": "transcript", "miRNA": "transcript"}, None, "ID", None, None, "Alias", ("source", "Alias")),
    ("generic", "gff"): Flavour(TYPES, *_BY_ID, "gene_name"),
    ("generic", "gtf"): Flavour(TYPES, *_BY_NAME, "gene_name"),
}


@dataclass
class Filter:
    """TX-11: what is kept. The first rule that fails names the reason.

    fields: kind (gene, transcript) -> attribute -> (allowed values, whether a missing attribute is allowed); values are split at commas.
    types: kind -> feature types; regions: (chrom, first, last), one of which a row must overlap; not_regions: none of which it may."""

    chroms: list[str] | None = None
    not_chroms: list[str] = field(default_factory=list)
    transcript_ids: list[str] | None = None
    fields: dict[str, dict[str, tuple[list[str], bool]]] = field(default_factory=dict)
    gene_ids: list[str] | None = None
    types: dict[str, list[str]] = field(default_factory=dict)
    regions: list[tuple[str, int, int]] | None = None
    not_regions: list[tuple[str, int, int]] = field(default_factory=list)

    def label(self, kind: str) -> Column:
        """The reason why a row of (chrom, id, attrs) goes, or null."""
        rules = [("chrom", F.col("chrom").isin(self.not_chroms) if self.not_chroms else F.lit(False))]
        if self.chroms is not None:
            rules.append(("chrom", ~F.col("chrom").isin(self.chroms)))
        if kind == "transcript" and self.transcript_ids is not None:
            rules.append(("transcript_id", ~F.col("id").isin(self.transcript_ids)))
        if kind == "gene" and self.gene_ids is not None:
            rules.append(("gene_id", ~F.col("id").isin(self.gene_ids)))
        if kind in self.types:
            rules.append(("feature_type", ~F.col("raw_type").isin(self.types[kind])))
        touches = lambda r: (F.col("chrom") == r[0]) & (F.col("start_") <= r[2]) & (F.col("end_") >= r[1])
        if self.regions is not None:
            rules.append(("region", ~reduce(lambda x, y: x | y, map(touches, self.regions), F.lit(False))))
        if self.not_regions:
            rules.append(("region", reduce(lambda x, y: x | y, map(touches, self.not_regions))))
        for name, (values, missing) in self.fields.get(kind, {}).items():
            value = F.try_element_at("attrs", F.lit(name))
            allowed = F.arrays_overlap(F.split(value, ","), F.array(*(F.lit(v) for v in values)))
            rules.append((name, F.when(value.isNull(), F.lit(not missing)).otherwise(~allowed)))
        out = F.lit(None).cast("string")
        for name, fails in reversed(rules):
            out = F.when(fails, name).otherwise(out)
        return out


class Built(NamedTuple):
    """features: kind (gene, transcript, part, custom), feature_type, raw_type (the source's), id, parent, gene_id, gene_name, chrom, start_, end_, strand, attrs;
    log: kind, label, n (label "kept" for those kept, kind "other" for types that the flavour leaves out)."""

    features: DataFrame
    log: DataFrame


def build(gff: DataFrame, flavour: Flavour, keep: Filter | None = None, custom: list[str] | None = None, names: DataFrame | None = None) -> Built:
    """TX-01 to TX-06, TX-13: joins and one aggregate for each pass; nothing is gathered but what the driver asks for.

    Genes and transcripts are filtered; transcripts go whose gene was filtered or doesn't envelop them; a gene that no row has is
    made as the hull of its transcripts, on the chromosome and strand of the first; parts without a kept transcript go; genes
    without one, too. Ids are unique; parts are numbered in genomic order. custom: further types, kept as features without
    parents under the gene's id attribute (TX-05). names: (alias, name): gene names that are an alias become its name (SC-23).
    A column source of gff, if there is one, counts as an attribute."""
    keep = keep or Filter()
    attr = lambda name: F.try_element_at("attrs", F.lit(name))
    place = ["chrom", "start_", "end_", "strand", "attrs", "raw_type"]
    if "source" in gff.columns:
        own = F.filter(F.map_entries(F.coalesce("attrs", F.expr("cast(map() AS map<string,string>)"))), lambda x: x["key"] != "source")
        gff = gff.withColumn("attrs", F.map_from_entries(F.concat(own, F.when(F.col("source").isNotNull(), F.array(F.struct(F.lit("source").alias("key"), F.col("source").alias("value")))).otherwise(F.expr("cast(array() AS array<struct<key: string, value: string>>)")))))
    # all passes read the rows: their attributes are parsed once
    gff = cut(gff.select("feature_type", F.col("feature_type").alias("raw_type"), "chrom", "start_", "end_", "strand", "attrs"))

    def of(types: dict[str, str], **ids: Column) -> DataFrame:
        name = F.create_map(*(F.lit(x) for kv in types.items() for x in kv)) if types else F.create_map().cast("map<string,string>")
        return gff.filter(F.col("feature_type").isin(list(types))).select(F.try_element_at(name, F.col("feature_type")).alias("feature_type"), *(v.alias(k) for k, v in ids.items()), *place)

    genes = of(flavour.of("gene") if flavour.gene_id else {}, id=attr(flavour.gene_id or ""), gene_name=attr(flavour.gene_name))
    genes = genes.withColumn("label", F.coalesce(keep.label("gene"), F.when(F.col("id").isNull(), "no_id")))
    own_gene = attr(flavour.transcript_gene) if flavour.transcript_gene else F.concat(F.lit("gene_"), attr(flavour.transcript_id))
    tx = of(flavour.of("transcript"), id=attr(flavour.transcript_id), gene_id=own_gene, gene_name=attr(flavour.gene_name))
    tx = tx.withColumn("own", F.coalesce(keep.label("transcript"), F.when(F.col("id").isNull() | F.col("gene_id").isNull(), "no_id")))
    known = genes.filter("id IS NOT NULL").select(F.col("id").alias("gene_id"), F.col("label").alias("gene_label"), F.col("start_").alias("gs"), F.col("end_").alias("ge"), F.col("chrom").alias("gc"))
    tx = tx.join(known, "gene_id", "left").withColumn("missing", F.col("gc").isNull())
    outside = ~F.col("missing") & ((F.col("gc") != F.col("chrom")) | (F.col("start_") < F.col("gs")) | (F.col("end_") > F.col("ge")))
    tx = tx.withColumn("label", F.coalesce("own", F.when(F.col("gene_label").isNotNull(), "parent_filtered"), F.when(outside, "not_enveloped")))
    lost = tx.filter("missing AND label IS NULL").groupBy("gene_id").agg(F.min(F.struct("start_", "end_", "id", "chrom", "strand")).alias("first"))
    tx = tx.join(lost, "gene_id", "left")
    differs = F.col("missing") & F.col("label").isNull() & ((F.col("chrom") != F.col("first.chrom")) | ~F.col("strand").eqNullSafe(F.col("first.strand")))
    tx = cut(tx.withColumn("label", F.coalesce("label", F.when(differs, "gene_differs"))).drop("first", "gs", "ge", "gc", "own", "gene_label"))
    good = tx.filter("label IS NULL")
    first = lambda c: F.min_by(c, F.struct("start_", "end_", "id"))
    copied = F.map_filter("attrs", lambda k, v: k.isin(list(flavour.copied))) if flavour.copied else F.lit(None).cast("map<string,string>")
    made = good.filter("missing").groupBy("gene_id").agg(F.min("chrom").alias("chrom"), F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.min("strand").alias("strand"), first("gene_name").alias("gene_name"), first(copied).alias("attrs"))
    used = good.select(F.col("gene_id").alias("id")).distinct().withColumn("used", F.lit(True))
    genes = genes.join(used, "id", "left").withColumn("label", F.coalesce("label", F.when(F.col("used").isNull(), "empty")))

    parts = of(flavour.of("part") if flavour.part_transcript else {}, parent=attr(flavour.part_transcript or "")).withColumn("id", F.lit(None).cast("string")).withColumn("own", keep.label("part"))
    parts = parts.join(good.select(F.col("id").alias("parent"), "gene_id"), "parent", "left").withColumn("label", F.coalesce("own", F.when(F.col("gene_id").isNull(), "orphan")))
    number = F.row_number().over(Window.partitionBy("parent", "feature_type").orderBy("start_", "end_")) - 1
    others = of({t: t for t in custom or []}, id=attr(flavour.gene_id or flavour.transcript_id))
    others = others.withColumn("label", F.coalesce(keep.label("custom"), F.when(F.col("id").isNull(), "no_id")))

    none = F.lit(None).cast("string")
    row = lambda df, kind, type_, raw, id_, parent, gene, name, attrs: df.select(F.lit(kind).alias("kind"), type_.alias("feature_type"), raw.alias("raw_type"), id_.alias("id"), parent.alias("parent"), gene.alias("gene_id"), name.alias("gene_name"), "chrom", "start_", "end_", "strand", attrs.alias("attrs"))
    c = F.col
    named = F.coalesce("gene_name", "id")
    features = row(genes.filter("label IS NULL"), "gene", c("feature_type"), c("raw_type"), c("id"), none, c("id"), named, c("attrs"))
    features = features.unionByName(row(made, "gene", F.lit("gene"), none, c("gene_id"), none, c("gene_id"), F.coalesce("gene_name", "gene_id"), c("attrs")))
    if names is not None:
        known_names = names.select(F.col("alias").alias("gene_name"), F.col("name").alias("_name")).dropDuplicates(["gene_name"])
        features = features.join(known_names, "gene_name", "left").withColumn("gene_name", F.coalesce("_name", "gene_name")).drop("_name")
    features = features.unionByName(row(good, "transcript", c("feature_type"), c("raw_type"), c("id"), c("gene_id"), c("gene_id"), none, c("attrs")))
    numbered = parts.filter("label IS NULL").withColumn("id", F.concat_ws("_", "parent", "feature_type", number.cast("string")))
    features = features.unionByName(row(numbered, "part", c("feature_type"), c("raw_type"), c("id"), c("parent"), c("gene_id"), none, c("attrs")))
    features = features.unionByName(row(others.filter("label IS NULL"), "custom", c("feature_type"), c("raw_type"), c("id"), none, none, none, c("attrs")))
    labels = [df.select(F.lit(kind).alias("kind"), F.coalesce("label", F.lit("kept")).alias("label")) for kind, df in (("gene", genes), ("transcript", tx), ("part", parts), ("custom", others))]
    labels.append(made.select(F.lit("gene").alias("kind"), F.lit("made").alias("label")))
    seen = [*(flavour.of("gene") if flavour.gene_id else ()), *flavour.of("transcript"), *(flavour.of("part") if flavour.part_transcript else ()), *(custom or [])]
    labels.append(gff.filter(~F.col("raw_type").isin(seen)).select(F.lit("other").alias("kind"), F.col("raw_type").alias("label")))
    log = reduce(DataFrame.unionByName, labels).groupBy("kind", "label").agg(F.count("*").alias("n"))
    return Built(features, log)


def outside_parent(features: DataFrame) -> DataFrame:
    """TX-09: features that their parent does not envelop; none in what build() gives, unless an exon leaves its transcript."""
    parent = features.select(F.col("id").alias("parent"), F.col("chrom").alias("pc"), F.col("start_").alias("ps"), F.col("end_").alias("pe"))
    return features.join(parent, "parent").filter("pc <> chrom OR start_ < ps OR end_ > pe").select("id", "parent")


def descendants(features: DataFrame, gene_ids: list[str]) -> DataFrame:
    """TX-17: all features of genes, themselves included."""
    return features.filter(F.col("gene_id").isin(gene_ids))


def insert(features: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TX-16: features with those of new (id, feature_type, chrom, start_, end_, strand and maybe parent, attrs) added, and the rows that can't be,
    each with a reason: its chromosome or its parent is unknown, its id is taken (or given twice), or its parent does not envelop it."""
    given = new if "parent" in new.columns else new.withColumn("parent", F.lit(None).cast("string"))
    given = given if "attrs" in given.columns else given.withColumn("attrs", F.lit(None).cast("map<string,string>"))
    chroms = features.select("chrom").distinct().withColumn("_chrom", F.lit(True))
    taken = features.select("id").distinct().withColumn("_taken", F.lit(True))
    above = features.select(F.col("id").alias("parent"), F.col("gene_id").alias("_gene"), F.col("chrom").alias("_pc"), F.col("start_").alias("_ps"), F.col("end_").alias("_pe"))
    given = given.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    told = given.join(chroms, "chrom", "left").join(taken, "id", "left").join(above, "parent", "left")
    inside = (F.col("_pc") == F.col("chrom")) & (F.col("_ps") <= F.col("start_")) & (F.col("end_") <= F.col("_pe"))
    reason = (
        F.when(F.col("_chrom").isNull(), "chrom")
        .when(F.col("_taken").isNotNull() | (F.col("_n") > 1) | F.col("id").isNull(), "id")
        .when(F.col("parent").isNotNull() & F.col("_pc").isNull(), "parent")
        .when(F.col("parent").isNotNull() & ~inside, "not_enveloped")
    )
    told = told.withColumn("reason", reason)
    good = told.filter("reason IS NULL").withColumns({"kind": F.lit("custom"), "gene_id": F.col("_gene")})
    return features.unionByName(good.select(*(c for c in features.columns if c in good.columns)), allowMissingColumns=True), told.filter("reason IS NOT NULL").select(*new.columns, "reason")


def find_attribute(features: DataFrame, values: DataFrame) -> DataFrame:
    """TX-18, TX-19: (id, owner, value) of each feature: values (id, value) of itself, or of the nearest of its ancestors that has one; features
    without are left out. A feature that is its own ancestor is an error.

    Pointers are doubled: each round a feature looks where its pointer looks, so n levels take log n joins, each cut off."""
    own = values.filter("value IS NOT NULL").select("id", "value").dropDuplicates(["id"])
    nodes = features.select("id", "parent").filter("id IS NOT NULL").dropDuplicates(["id"])
    found = nodes.join(own.select("id", F.col("id").alias("owner")), "id", "left").withColumn("next", F.when(F.col("owner").isNull(), F.col("parent"))).select("id", "owner", "next")
    limit = max(1, nodes.count()).bit_length() + 1
    for step in range(limit + 1):
        found = cut(found)
        if found.filter("next IS NOT NULL").isEmpty():
            return found.filter("owner IS NOT NULL").join(own.withColumnRenamed("id", "owner"), "owner").select("id", "owner", "value")
        there = found.select(F.col("id").alias("next"), F.col("owner").alias("_owner"), F.col("next").alias("_next"))
        found = found.join(there, "next", "left").select("id", F.coalesce("owner", "_owner").alias("owner"), F.col("_next").alias("next"))
    raise ValueError("a feature is its own ancestor")


def slice_attribute(features: DataFrame, values: DataFrame) -> DataFrame:
    """TX-19: (id, value) of each feature: its own value, or the part of its nearest ancestor's that lies above it. Values are strings or
    arrays with one item for each position of their owner."""
    spans = features.select("id", "start_", "end_").dropDuplicates(["id"])
    owners = spans.select(F.col("id").alias("owner"), F.col("start_").alias("_start"))
    at = find_attribute(features, values).join(spans, "id").join(owners, "owner")
    first, size = (F.col("start_") - F.col("_start") + 1).cast("int"), (F.col("end_") - F.col("start_") + 1).cast("int")
    part = F.slice("value", first, size) if dict(values.dtypes)["value"].startswith("array") else F.substring("value", first, size)
    return at.select("id", F.when(F.col("id") == F.col("owner"), F.col("value")).otherwise(part).alias("value"))
