import random

import pytest
from pyspark.sql import functions as F

from stranda.functions import sequence as sq
from stranda.operators import mates
from stranda.sources import fastq, text

READ = "uid long, name string, chrom string, start_ long, end_ long, flag int, seq string"


def test_mates_pair_in_the_order_of_the_scan(spark):
    rows = [
        (1, "p", "a", 10, 20, 64, "AC"), (2, "p", "a", 30, 44, 128 + 16, "GG"),  # the first read comes first
        (3, "q", "a", 10, 20, 128 + 16, "GG"), (4, "q", "a", 15, 19, 64, "AC"),  # the second does
        (5, "o", "a", 50, 60, 128, "TT"), (6, "d", "a", 1, 9, 64, "A"), (7, "d", "b", 1, 9, 128, "C"),
        (8, None, "a", 1, 2, 64, "G"), (9, None, "a", 1, 2, 64, "G"), (10, "t", "a", 1, 5, 64, "A"), (11, "t", "a", 2, 6, 128, "C"), (12, "t", "a", 3, 7, 64, "T"),
    ]
    got = mates.pairs(spark.createDataFrame(rows, READ), ["chrom", "start_", "uid"]).collect()
    by = {(r.name, r.kind): r for r in got}
    uid = lambda r: r.uid if r else None
    show = lambda r: (r.chrom, r.start_, r.end_, r.strand, uid(r.r1), uid(r.r2))
    assert show(by["p", "pair"]) == ("a", 10, 44, "+", 1, 2) and show(by["q", "pair"]) == ("a", 10, 20, "-", 4, 3)
    assert show(by["o", "orphan"]) == ("a", 50, 60, "+", None, 5) and show(by["d", "discordant"]) == (None, None, None, None, 6, 7)
    assert show(by["t", "pair"])[4:] == (10, 11) and show(by["t", "orphan"])[4:] == (12, None)
    assert sum(r.kind == "orphan" and r.name is None for r in got) == 2 and len(got) == 8


def test_duplicates_go_by_left_end_and_sequences(spark):
    rows = []
    for i, (start, s1, s2) in enumerate([(5, "AAA", "CC"), (5, "AAA", "CC"), (5, "CCC", "CC"), (6, "AAA", "CC"), (5, "AAA", "CC"), (5, "*", "*"), (5, "*", "*")]):
        rows += [(2 * i, f"n{i}", "a", start, 20, 64, s1), (2 * i + 1, f"n{i}", "a", start + 3, 30 + i, 128, s2)]
    rows += [(90, "o1", "a", 5, 9, 64, "AAA"), (91, "o2", "a", 5, 9, 64, "AAA")]
    found = mates.pairs(spark.createDataFrame(rows, READ), ["chrom", "start_", "uid"])
    assert sorted(r.name for r in mates.without_duplicates(found).collect()) == ["n0", "n2", "n3", "n5", "n6", "o1"]


def aligned(rng):
    """(start, cigar, md, seq, mismatches) of a random alignment."""
    start, at, seq, cigar, tokens, out, run = rng.randrange(1, 99), 0, "", "", "", [], 0
    at = start
    for i in range(rng.randrange(1, 6)):
        op, n = ("M" if i % 2 == 0 else rng.choice("IDN")), rng.randrange(1, 7)
        cigar += f"{n}{op}"
        if op == "D":
            tokens += f"{run}^{''.join(rng.choice('ACGT') for _ in range(n))}"
            run = 0
        if op in "DN":
            at += n
        if op == "I":
            seq += "".join(rng.choice("ACGT") for _ in range(n))
        if op == "M":
            for _ in range(n):
                base = rng.choice("ACGT")
                if rng.random() < 0.3:
                    ref = rng.choice([x for x in "ACGT" if x != base])
                    out.append([len(seq), at, ref, base])
                    tokens += f"{run}{ref}"
                    run = 0
                else:
                    run += 1
                seq, at = seq + base, at + 1
    clip = rng.randrange(4)
    if clip:
        cigar, seq, out = f"2H{clip}S{cigar}", "T" * clip + seq, [[o + clip, *x] for o, *x in out]
    return start, cigar + "3S", tokens + str(run), seq + "GGG", [tuple(x) for x in out]


def test_mismatches_by_md_equal_those_planted(spark):
    rng = random.Random(7)
    rows = [(i, *x[:4], [rng.randrange(40) for _ in x[3]], x[4]) for i, x in enumerate(aligned(rng) for _ in range(300))]
    df = spark.createDataFrame([r[:6] for r in rows], "uid long, start_ long, cigar string, md string, seq string, quals array<int>")
    c = F.col
    got = df.select("uid", sq.md_mismatches(c("start_"), c("cigar"), c("md"), c("seq")).alias("m"), sq.md_mismatches(c("start_"), c("cigar"), c("md"), c("seq"), c("quals"), 20).alias("good")).collect()
    for r in got:
        want = rows[r.uid][6]
        assert [tuple(x) for x in r.m] == want and [tuple(x) for x in r.good] == [x for x in want if rows[r.uid][5][x[0]] >= 20]


RECORDS = [(f"@r{i} x/1", s, "".join("@+I!"[(i + k) % 4] for k in range(len(s)))) for i, s in enumerate(["ACGT", "", "N", "GATTACA", "CC", "ACGTACGTAC"])]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_is_the_same_wherever_it_is_cut(spark, tmp_path, end):
    body = "".join(f"{n}{end}{s}{end}+{end}{q}{end}" for n, s, q in RECORDS)
    path = str(tmp_path / "a.fastq")
    (tmp_path / "a.fastq").write_bytes(body.encode())
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        for size in (1, 7, 23, 40, 77, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(map(tuple, fastq.read_fastq(spark, path).collect())) == sorted(RECORDS), size
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert fastq.count_records(spark, path) == len(RECORDS)
    (tmp_path / "b.fastq").write_text("@a\nAC\n+\n")
    assert [tuple(r) for r in fastq.read_fastq(spark, str(tmp_path / "b.fastq")).collect()] == [("@a", "AC", None)]
    with pytest.raises(ValueError):
        fastq.count_records(spark, str(tmp_path / "b.fastq"))


def test_reads_of_alignments(spark):
    reads = spark.createDataFrame([("@r1/1 extra", "A", "I"), ("@r2", "C", "I"), ("@r3/2", "G", "I"), ("@r4", "T", "I")], "name string, seq string, qual string")
    lines = ["r1\t0\tx\t10\t9\t1M\t*\t0\t0\tA\tI", "r2\t0\tx\t99\t9\t1M\t*\t0\t0\tA\tI", "r3\t0\ty\t10\t9\t1M\t*\t0\t0\tA\tI", "r4\t4\t*\t0\t0\t*\t*\t0\t0\tT\tI"]
    sam = text.sam_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.name for r in fastq.of_alignments(reads, sam, "x:5-20").collect()] == ["@r1/1 extra"]
    assert sorted(r.name for r in fastq.of_alignments(reads, sam).collect()) == ["@r1/1 extra", "@r2", "@r3/2"]
    assert [tuple(r) for r in fastq.unaligned(sam).collect()] == [("@r4", "T", "I")]


def test_odd_rows_of_text_formats(spark):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [r.chrom for r in text.bed_rows(rows("track name=x", "track1\t1\t5", "browser", "browser_x\t2\t3")).collect()] == ["track1", "browser_x"]
    got = text.vcf_rows(rows("1\t5\t.\tA\tC\t.\tPASS\tDP=1;DP=2\tGT:DP\t0/1:7\t./.", "1\t6\t.\tA\tC\t.\tPASS\t.\tGT\t./.\t.")).collect()
    assert got[0].info == {"DP": "2"} and got[0].fields == [{"GT": "0/1", "DP": "7"}, {"GT": "./."}] and len(got) == 2
    assert [r.pos for r in text.vcf_rows(rows("1\t5\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t./.", "1\t6\t.\tA\tC\t.\tPASS\t.\tGT\t./.\t1/1"), samples=[1], only_called=True).collect()] == [6]
    assert text.sam_rows(rows("r\t0\tx\t1\t9\t1M\t*\t0\t0\tA\tI\tNH:i:1\tNH:i:3")).first().tags == {"NH": "3"}
    odd = spark.createDataFrame([("x", "gene", 1, 5, "a;b=c,50% &\td")], "chrom string, feature_type string, start_ long, end_ long, note string")
    lines = text.gff_lines(odd, "note")
    assert "a%3Bb%3Dc%2C50%25 %26%09d" in lines.first().value and text.gff_rows(lines, decode=True).first().attrs == {"note": "a;b=c,50% &\td"}
    assert text.gff_rows(lines, types=["exon"]).count() == 0
