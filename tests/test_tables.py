import math

import pytest
from pyspark.sql import functions as F

from stranda.operators import annotation, references, tables
from stranda.sources import text
from stranda.sources import transcriptome as files

REF = "chrom string, place long, length long"


def write(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_contigs_of_headers(spark, tmp_path):
    sam = write(tmp_path, "a.sam", "@HD\tVN:1.6\n@SQ\tSN:b\tLN:20\n@SQ\tAS:x\tSN:a\n@PG\tID:p\nr1\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert rows(references.read_contigs(spark, sam).orderBy("place")) == [("b", 0, 20), ("a", 1, None)]
    vcf = write(tmp_path, "a.vcf", "##fileformat=VCFv4.2\n##contig=<ID=2,length=7>\n##contig=<ID=1>\n#CHROM\tPOS\n")
    assert rows(references.read_contigs(spark, vcf).orderBy("place")) == [("2", 0, 7), ("1", 1, None)]


def test_contigs_of_a_header_split_at_any_byte(spark, tmp_path):
    path = write(tmp_path, "b.sam", "".join(f"@SQ\tSN:c{i}\tLN:{i}\n" for i in range(30)))
    for size in (16, 23, 64):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert rows(references.read_contigs(spark, path).orderBy("place")) == [(f"c{i}", i, i) for i in range(30)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_merged_dictionaries(spark):
    a = spark.createDataFrame([("x", 0, 10), ("y", 1, None), ("z", 2, 5)], REF)
    b = spark.createDataFrame([("y", 0, 7), ("q", 1, 1), ("x", 2, None)], REF)
    assert rows(references.merged(a, b).orderBy("place")) == [("x", 0, 10), ("y", 1, 7)]
    assert rows(references.merged(a, b, included=["y"])) == [("y", 0, 7)]
    assert rows(references.merged(a, a.limit(0))) == []
    with pytest.raises(Exception, match="order differs"):
        references.merged(a, b, check_order=True).select("chrom").collect()
    wrong = spark.createDataFrame([("x", 0, 11)], REF)
    with pytest.raises(Exception, match="lengths differ: x"):
        references.merged(a, wrong).select("place").collect()
    assert rows(references.merged(a, wrong, included=["z"])) == []


def test_order_by_a_reference(spark):
    ref = spark.createDataFrame([("y", 0, None), ("x", 1, None)], REF)
    df = spark.createDataFrame([("x", 1, 2), ("y", 5, 6), ("y", 5, 5), ("q", 1, 1)], "chrom string, start_ long, end_ long")
    want = [("y", 5, 5), ("y", 5, 6), ("x", 1, 2)]
    assert rows(references.in_order(df, ref)) == want and rows(references.in_order(df, ref, reverse=True)) == want[::-1]


def test_describe_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 3.0, None), (None, None, None)], "k string, v double, w int")
    got = {r["column"]: tuple(r)[1:] for r in tables.describe(df).collect()}
    assert got["k"] == (2, 2, "a", 1, None, None, None, None)
    assert got["v"] == (2, 2, "1.0", 1, 2.0, math.sqrt(2), 1.0, 3.0)
    assert got["w"] == (0, 0, None, None, None, None, None, None)
    assert [r.n for r in tables.describe(df.limit(0)).collect()] == [0, 0, 0]
    places = "chrom string, start_ long, end_ long"
    facts = lambda x: rows(tables.located(spark.createDataFrame(x, places)))[0]
    assert facts([("x", 1, 5), ("x", 6, 9), ("y", 1, 5)]) == (3, 3, False, False)
    assert facts([("x", 1, 5), ("x", 5, 9), ("x", 3, 2)]) == (3, 1, True, True)
    assert facts([]) == (0, 0, False, False)


def test_decay_has_the_least_squared_error(spark):
    curves = {"a": [(t, math.exp(-0.15 * t)) for t in (0, 1, 2, 4, 8)], "b": [(t, y) for t, y in ((0, 1.1), (1, 0.7), (1, 0.8), (3, 0.2), (6, 0.2))], "c": [(0, 0.5)], "d": [(t, math.exp(0.05 * t)) for t in (1, 2, 3)], "e": [(5, 0.0), (5, None)]}
    df = spark.createDataFrame([(g, float(t), y) for g, p in curves.items() for t, y in p], "g string, t double, y double")
    got = {r.g: (r.k, r.half_life) for r in tables.fit_decay(df, ["g"], "t", "y").collect()}
    error = lambda g, k: sum((y - math.exp(-k * t)) ** 2 for t, y in curves[g] if y is not None)
    assert got["a"][0] == pytest.approx(0.15) and got["a"][1] == pytest.approx(math.log(2) / 0.15)
    assert error("b", got["b"][0]) <= min(error("b", i / 1000) for i in range(3000)) + 1e-12
    assert got["c"] == (None, None) and got["d"][0] == pytest.approx(-0.05) and error("e", got["e"][0]) < 1e-6


GFF = [
    "1\tx\tgene\t1\t100\t.\t-\t.\tID=g;gene_name=n%3B1;gene_type=a,b",
    "1\tx\tmRNA\t1\t100\t.\t-\t.\tID=t;Parent=g",
    "1\tx\tmRNA\t11\t20\t.\t-\t.\tID=u;Parent=g",
    "1\tx\texon\t61\t100\t.\t-\t.\tParent=t",
    "1\tx\texon\t1\t40\t.\t-\t.\tParent=t",
    "1\tx\tCDS\t31\t40\t.\t-\t0\tParent=t",
    "1\tx\tCDS\t61\t70\t.\t-\t2\tParent=t",
]


def test_files_of_a_transcriptome(spark):
    lines = spark.createDataFrame([(x,) for x in GFF], "value string")
    feats = annotation.build(text.gff_rows(lines), annotation.FLAVOURS["generic", "gff"]).features
    assert dict(rows(files.bed12_lines(feats))) == {"t": "1\t0\t100\tt\t.\t-\t30\t70\t255,153,153\t2\t40,40\t0,60", "u": "1\t10\t20\tu\t.\t-\t10\t20\t255,153,153\t0\t0\t10"}
    out = files.gff3_lines(feats, copied=("gene_type", "score"))
    assert {"1\tstranda\tgene\t1\t100\t.\t-\t.\tID=g;gene_name=n%3B1;gene_type=a,b", "1\tstranda\texon\t1\t40\t.\t-\t.\tID=t_exon_0;Parent=t"} < {r.value for r in out.collect()}
    again = annotation.build(text.gff_rows(out), annotation.FLAVOURS["generic", "gff"]).features
    key = ["kind", "feature_type", "id", "parent", "gene_name", "start_", "end_", "strand"]
    assert sorted(map(str, rows(again.select(*key)))) == sorted(map(str, rows(feats.select(*key))))
    decoded = annotation.build(text.gff_rows(lines, decode=True), annotation.FLAVOURS["generic", "gff"]).features
    assert rows(files.gff3_lines(decoded, types=("gene",), encode=True)) == [("1\tstranda\tgene\t1\t100\t.\t-\t.\tID=g;gene_name=n%3B1",)]


def test_aliases_end_at_symbols_in_use(spark, tmp_path):
    path = write(tmp_path, "a.tsv", "id\tsymbol\talias_symbol\tprev_symbol\n1\tA\tx| y |\told\n2\tB \ty|A\t\n3\tC\t\tx\n")
    got = files.read_aliases(spark, path)
    assert sorted(rows(got)) == [("old", "A"), ("x", "C"), ("y", "B")]
    gff = spark.createDataFrame([("1\tx\tgene\t1\t9\t.\t+\t.\tID=g;gene_name=old",), ("1\tx\tmRNA\t1\t9\t.\t+\t.\tID=t;Parent=g",)], "value string")
    feats = annotation.build(text.gff_rows(gff), annotation.FLAVOURS["generic", "gff"], names=got).features
    assert feats.filter("kind = 'gene'").first().gene_name == "A"


def test_rewritten_variants(spark, tmp_path):
    body = ["##fileformat=VCFv4.2", "##contig=<ID=2,length=7>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts", "2\t1\trs1;rs2\tA\tC\t.\tPASS\tDP=3\tGT\t0/1", "2\t2\trs3\tA\tC\t.\tPASS\t.", "2\t3\t.\tA\tC\t.\tPASS\tDB"]
    lines = spark.read.text(write(tmp_path, "a.vcf", "\n".join(body) + "\n"))
    moved = [r.value for r in files.id_to_info(lines, "RS").collect()]
    assert moved[:3] == [*body[:2], '##INFO=<ID=RS,Number=1,Type=String,Description="RS">']
    assert moved[4:] == ["2\t1\t.\tA\tC\t.\tPASS\tDP=3;RS=rs1,rs2\tGT\t0/1", "2\t2\t.\tA\tC\t.\tPASS\tRS=rs3", body[5]]
    ref = spark.createDataFrame([("9", 2, None), ("1", 0, 5), ("2", 1, 7)], REF)
    assert [r.value for r in files.add_contigs(lines, ref).collect()] == [*body[:2], "##contig=<ID=1,length=5>", "##contig=<ID=9>", *body[2:]]
    assert [r.value for r in files.add_contigs(lines, ref.filter(F.col("chrom") == "2")).collect()] == body
