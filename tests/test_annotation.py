import pytest
from pyspark.sql import functions as F

from stranda.operators import annotation as an
from stranda.sources import text


def gff(spark, *rows, gtf=False):
    """Rows of (type, start, end, attributes)."""
    lines = [(f"c1\tsrc\t{t}\t{s}\t{e}\t.\t+\t.\t{a}",) for t, s, e, a in rows]
    return text.gff_rows(spark.createDataFrame(lines, "value string"), gtf=gtf)


def show(built):
    return {(r.kind, r.id): r for r in built.features.collect()}, {(r.kind, r.label): r.n for r in built.log.collect()}


def by_id(t, gene="gene"):
    return [(gene, 1, 100, "ID=g1;Name=one;gene_name=uno"), (t, 5, 50, "ID=t1;Parent=g1"), ("exon", 5, 20, "Parent=t1"), ("CDS", 6, 9, "Parent=t1")]


def by_name(t):
    a = 'gene_id "g1"; transcript_id "t1"; gene_name "uno"; gene_symbol "sym";'
    return [("gene", 1, 100, 'gene_id "g1"; gene_name "uno"; gene_symbol "sym";'), (t, 5, 50, a), ("exon", 5, 20, a), ("5UTR", 6, 9, a)]


@pytest.mark.parametrize("source,form,raw,name", [
    ("gencode", "gff", "transcript", "uno"), ("gencode", "gtf", "transcript", "uno"), ("ensembl", "gff", "lnc_RNA", "one"), ("flybase", "gtf", "pseudogene", "sym"), ("wormbase", "gff", "ncRNA", "one"),
    ("ucsc", "gtf", "transcript", "uno"), ("chess", "gff", "transcript", None), ("chess", "gtf", "transcript", "uno"), ("generic", "gff", "ncRNA", "uno"), ("generic", "gtf", "tRNA", "uno"),
])
def test_every_flavour_builds_genes_transcripts_and_parts(spark, source, form, raw, name):
    flavour = an.FLAVOURS[source, form]
    rows, log = show(an.build(gff(spark, *(by_id(raw) if form == "gff" else by_name(raw)), gtf=form == "gtf"), flavour))
    assert rows["transcript", "t1"].raw_type == raw and rows["part", "t1_exon_0"].parent == "t1" and len(rows) == 4
    gene = rows["gene", "g1"]
    made = flavour.gene_id is None
    assert gene.gene_name == (name or "g1") and (gene.start_, gene.end_) == ((5, 50) if made else (1, 100))
    assert log.get(("other", "gene"), 0) == int(made)
    if made:
        assert gene.attrs["source"] == "src"


def test_flavours_of_small_rnas_have_a_gene_for_each_transcript(spark):
    for source, raw in (("mirgenedb", "pre_miRNA"), ("mirbase", "miRNA_primary_transcript")):
        rows, log = show(an.build(gff(spark, (raw, 5, 50, "ID=m1;Alias=x"), ("miRNA", 7, 20, "ID=m2"), ("exon", 7, 9, "Parent=m1")), an.FLAVOURS[source, "gff"]))
        assert set(rows) == {("gene", "gene_m1"), ("gene", "gene_m2"), ("transcript", "m1"), ("transcript", "m2")} and log["other", "exon"] == 1
        assert rows["gene", "gene_m1"].gene_name == "x" and rows["gene", "gene_m2"].gene_name == "gene_m2"


def test_types_that_mean_different_things(spark):
    rows, log = show(an.build(gff(spark, ("pseudogene", 1, 99, "ID=p1"), ("pseudogenic_transcript", 1, 99, "ID=pt;Parent=p1"), ("odd", 1, 2, "ID=o")), an.FLAVOURS["ensembl", "gff"]))
    assert set(rows) == {("gene", "p1"), ("transcript", "pt")} and log["other", "odd"] == 1
    rows, log = show(an.build(gff(spark, *by_id("pseudogenic_transcript")), an.FLAVOURS["wormbase", "gff"]))
    assert rows == {} and log == {("other", "pseudogenic_transcript"): 1, ("gene", "empty"): 1, ("part", "orphan"): 2}


def test_filters_by_region_id_and_type(spark):
    lines = gff(spark, *by_id("mRNA"), ("gene", 300, 400, "ID=g2"), ("ncRNA", 310, 320, "ID=t2;Parent=g2"), ("mRNA", 310, 330, "ID=t3;Parent=g2"), ("mRNA", 1, 2, "Parent=g2"))
    ids = lambda **k: {i for kind, i in show(an.build(lines, an.FLAVOURS["generic", "gff"], an.Filter(**k)))[0] if kind != "part"}
    assert ids() == {"g1", "t1", "g2", "t2", "t3"}
    assert ids(regions=[("c1", 90, 315)]) == {"g2", "t2", "t3"} and ids(regions=[("c1", 40, 45)]) == {"g1", "t1"} and ids(regions=[]) == set()
    assert ids(not_regions=[("c1", 325, 326)]) == {"g1", "t1"}
    assert ids(gene_ids=["g2"]) == {"g2", "t2", "t3"} and ids(types={"transcript": ["ncRNA"]}) == {"g2", "t2"}
    assert show(an.build(lines, an.FLAVOURS["generic", "gff"]))[1]["transcript", "no_id"] == 1


def test_custom_features_and_names(spark):
    lines = gff(spark, *by_id("mRNA"), ("enhancer", 500, 600, "ID=e1"), ("enhancer", 500, 600, "note=none"))
    names = spark.createDataFrame([("uno", "UNO1"), ("other", "x")], "alias string, name string")
    rows, log = show(an.build(lines, an.FLAVOURS["generic", "gff"], custom=["enhancer"], names=names))
    assert rows["custom", "e1"].parent is None and rows["custom", "e1"].feature_type == "enhancer" and log["custom", "no_id"] == 1
    assert rows["gene", "g1"].gene_name == "UNO1"


def test_insertion_says_what_it_refuses(spark):
    built = an.build(gff(spark, *by_id("mRNA")), an.FLAVOURS["generic", "gff"]).features
    new = spark.createDataFrame([("n1", "peak", "c1", 6, 7, "+", "t1"), ("n2", "peak", "c9", 6, 7, "+", None), ("t1", "peak", "c1", 6, 7, "+", None), ("n4", "peak", "c1", 6, 7, "+", "zz"), ("n5", "peak", "c1", 6, 70, "+", "t1"), ("n6", "peak", "c1", 900, 901, "+", None), ("n7", "p", "c1", 1, 2, "+", None), ("n7", "p", "c1", 1, 2, "+", None)], "id string, feature_type string, chrom string, start_ long, end_ long, strand string, parent string")
    out, refused = an.insert(built, new)
    added = {r.id: r for r in out.filter("kind = 'custom'").collect()}
    assert set(added) == {"n1", "n6"} and added["n1"].gene_id == "g1" and added["n6"].gene_id is None
    assert sorted((r.id, r.reason) for r in refused.collect()) == [("n2", "chrom"), ("n4", "parent"), ("n5", "not_enveloped"), ("n7", "id"), ("n7", "id"), ("t1", "id")]


def test_nearest_ancestor_over_many_levels_and_slices(spark):
    rows = [("a", None, 11, 30), ("b", "a", 13, 25), ("c", "b", 14, 20), ("d", "c", 15, 16), ("e", None, 1, 5), ("f", "e", 2, 3), ("g", "nowhere", 1, 2)] + [(f"z{i}", f"z{i - 1}" if i else None, 1, 9) for i in range(40)]
    features = spark.createDataFrame(rows, "id string, parent string, start_ long, end_ long")
    values = spark.createDataFrame([("a", "ABCDEFGHIJKLMNOPQRST"), ("c", "1234567"), ("z0", "123456789")], "id string, value string")
    got = {r.id: (r.owner, r.value) for r in an.find_attribute(features, values).collect()}
    assert got["d"] == ("c", "1234567") and got["b"][0] == "a" and got["z39"][0] == "z0" and not {"e", "f", "g"} & set(got)
    cut = {r.id: r.value for r in an.slice_attribute(features.filter("id < 'h'"), values).collect()}
    assert cut == {"a": "ABCDEFGHIJKLMNOPQRST", "b": "CDEFGHIJKLMNO", "c": "1234567", "d": "23"}
    arrays = values.select("id", F.split("value", "").alias("value"))
    assert {r.id: r.value for r in an.slice_attribute(features.filter("id < 'h'"), arrays).collect()}["d"] == ["2", "3"]
    with pytest.raises(ValueError):
        an.find_attribute(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "id string, parent string"), values.limit(0))
