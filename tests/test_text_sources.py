from stranda.sources import text


def write(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_bed_round_trip_and_bedgraph(spark, tmp_path):
    bed = text.read(spark, write(tmp_path, "a.bed", "track x\n1\t5\t10\tn1\t7\t+\n1\t9\t9\n2\t9\t150\tn2\t.\t-\t9\t150\t0\t2\t10,20,\t0,100,\n"))
    rows = {(r.chrom, r.start_): r for r in bed.collect()}
    assert rows["1", 6].end_ == 10 and rows["1", 10].strand is None and rows["2", 10].block_sizes == [10, 20] and rows["2", 10].score is None
    assert {r.value for r in text.bed_lines(bed).collect()} == {"1\t5\t10\tn1\t7\t+", "1\t9\t9\t.\t.\t.", "2\t9\t150\tn2\t.\t-"}
    graph = text.read(spark, write(tmp_path, "a.bedgraph", "track\n1\t0\t5\t1.5\n")).first()
    assert (graph.start_, graph.end_, graph.value) == (1, 5, 1.5)


def test_gff_and_gtf_attributes(spark, tmp_path):
    row = text.read(spark, write(tmp_path, "a.gff3", "##gff\n1\ts\tgene\t3\t9\t.\t-\t.\tID=g1;note=a=b;bad # c=d\n")).first()
    assert row.attrs == {"ID": "g1", "note": "a=b"} and (row.start_, row.end_, row.strand, row.score) == (3, 9, "-", None)
    row = text.read(spark, write(tmp_path, "a.gtf", '1\ts\texon\t3\t9\t2.5\t+\t0\tgene_id "g 1"; tag "x"; tag "y";\n')).first()
    assert row.attrs == {"gene_id": "g 1", "tag": "y"} and row.phase == 0


def test_vcf_locations_and_filters(spark, tmp_path):
    lines = ["1\t10\t.\tA\tG\t.\tPASS\tDP=3;DB\tGT\t0/1", "1\t10\t.\tACG\tA\t.\t.\t.\tGT\t1/1", "1\t10\t.\tA\tATT,C\t9\tPASS\t.", "1\t10\t.\tC\t<DEL>\t.\tPASS\tEND=20", "1\t10\t.\tC\tT\t.\tLowQual\t."]
    path = write(tmp_path, "a.vcf", "##x\n#CHROM\n" + "\n".join(lines) + "\n")
    got = [(r.kind, r.start_, r.end_) for r in text.read(spark, path).collect()]
    assert got == [("SNP", 10, 10), ("DEL", 11, 12), ("INS", 10, 10), ("SV", 10, 20)]
    first = text.read_vcf(spark, path, only_pass=False).first()
    assert first.info == {"DP": "3", "DB": "true"} and first.genotypes == ["0/1"]


def test_sam(spark, tmp_path):
    row = text.read(spark, write(tmp_path, "a.sam", "@HD\tVN:1\nr1\t16\t1\t100\t60\t6S10M5N10M\t*\t0\t0\tACGT\tIIII\tNH:i:2\txc:Z:a:b\n")).first()
    assert (row.start_, row.end_, row.strand, row.tags) == (100, 124, "-", {"NH": "2", "xc": "a:b"})
    assert text.guess_format("x/y.vcf.gz") == "vcf" and text.guess_format("x.gff") is None
