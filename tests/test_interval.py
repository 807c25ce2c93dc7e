"""Literal cases of the interval algebra."""

import pytest
from pyspark.sql import functions as F

from stranda.functions import interval as iv
from stranda.functions import sequence as sq
from stranda.operators import islands, joins

S = "chrom string, start_ long, end_ long, strand string"


def one(spark, expr, *intervals):
    cols = [iv.Interval(F.lit(c), F.lit(s).cast("long"), F.lit(e).cast("long"), F.lit(d).cast("string")) for c, s, e, d in intervals]
    return spark.range(1).select(expr(*cols).alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("1", 1, 10, None), ("1", 1, 10, None), 0), (("1", 1, 10, None), ("1", 10, 20, None), 0), (("1", 10, 20, None), ("1", 25, 30, None), 5),
        (("1", 25, 30, None), ("1", 1, 10, None), -15), (("1", 1, 10, None), ("2", 1, 10, None), None), (("2", 1, 10, None), ("2", 11, 12, None), 1),
    ],
)
def test_distance(spark, a, b, want):
    assert one(spark, iv.distance, a, b) == want


def test_overlap_envelop_and_strands(spark):
    assert one(spark, iv.overlap, ("1", 1, 10, None), ("1", 5, 20, None)) == 6
    assert one(spark, iv.overlap, ("1", 1, 10, None), ("1", 11, 20, None)) == 0
    assert one(spark, lambda a, b: iv.overlaps(a, b, True), ("1", 1, 10, "+"), ("1", 5, 20, "-")) is False
    assert one(spark, lambda a, b: iv.overlaps(a, b, True), ("1", 1, 10, None), ("1", 5, 20, None)) is True
    assert one(spark, iv.overlaps, (None, 0, iv.MAX_INT, None), ("1", 5, 4, None)) is True
    assert one(spark, iv.overlaps, ("1", 5, 4, None), ("1", 1, 10, None)) is False
    assert one(spark, iv.envelops, ("1", 1, 10, None), ("1", 2, 9, None)) is True
    assert one(spark, iv.is_adjacent, ("1", 1, 10, None), ("1", 11, 12, None)) is True
    assert [one(spark, iv.length, x) for x in (("1", 1, 10, None), ("1", 3, 2, None), ("1", 0, 9, None))] == [10, 0, iv.MAX_INT]


def test_subtract_and_pieces(spark):
    flat = lambda rows: [tuple(r) for r in rows]
    assert flat(one(spark, iv.subtract, ("1", 1, 10, None), ("1", 2, 9, None))) == [(1, 1), (10, 10)]
    assert flat(one(spark, iv.subtract, ("1", 1, 10, None), ("1", 1, 3, None))) == [(4, 10)]
    assert flat(one(spark, iv.subtract, ("1", 1, 10, None), ("1", 1, 10, None))) == []
    assert flat(one(spark, iv.subtract, ("1", 1, 10, None), ("1", 20, 30, None))) == [(1, 10)]
    assert flat(one(spark, lambda a: iv.pieces(a, 4), ("1", 1, 10, None))) == [(1, 4), (5, 8), (9, 10)]


def test_parse_and_render(spark):
    texts = ["chr1:1,000-2000 (+)", "NT_167251.1:3-9", "bad", "1:x-y"]
    got = [tuple(r.p) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iv.parse(F.col("t")).alias("p")).collect()]
    assert got == [("chr1", 1000, 2000, "+"), ("NT_167251.1", 3, 9, None), (None,) * 4, (None,) * 4]
    assert one(spark, iv.render, ("1", 2, 3, "-")) == "1:2-3 (-)" and one(spark, iv.render, ("1", 2, 3, None)) == "1:2-3"


def test_merge_literals_and_tiles(spark):
    lists = {
        False: ([(3, 9), (2, 6), (8, 10), (15, 18)], [(2, 10), (15, 18)]),
        True: ([(1, 3), (4, 10), (5, 12), (6, 8), (20, 33), (30, 35)], [(1, 12), (20, 35)]),
    }
    for adjacent, (given, want) in lists.items():
        df = spark.createDataFrame([("1", s, e, None) for s, e in given], S)
        for tile in (3, 7, 1 << 16):
            assert sorted((r.start_, r.end_) for r in islands.merge(df, ["chrom"], adjacent, tile).collect()) == want


def test_binned_join_equals_plain_join(spark):
    left = spark.range(300).select(F.col("id").alias("uid"), F.concat(F.lit("c"), F.col("id") % 3).alias("chrom"), (F.pmod(F.xxhash64("id"), F.lit(900)) - 50).alias("start_"), F.lit(None).cast("string").alias("strand")).withColumn("end_", F.col("start_") + F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(250)) - 3)
    a, b = left.alias("a"), left.alias("b")
    plain = a.join(b, F.expr("a.chrom = b.chrom AND a.start_ <= b.end_ AND b.start_ <= a.end_ AND a.start_ <= a.end_ AND b.start_ <= b.end_")).select("a.uid", F.col("b.uid").alias("r_uid"))
    for size in (8, 64, 1000):
        got = joins.overlap_pairs(left, left, size).select("uid", "r_uid")
        assert got.count() == plain.count() and got.exceptAll(plain).count() == 0


def test_sequences(spark):
    row = spark.range(1).select(
        sq.reverse_complement(F.lit("ACTGnU")).alias("rc"), sq.gc_count(F.lit("ACGTg")).alias("gc"), sq.pad_n(F.lit("ACG"), 6).alias("pad"), sq.windows(F.lit("ACGTACG"), 4, 3).alias("w"),
        sq.kmer_count(F.lit("AAAA"), "AA").alias("k"), F.transform(F.array(*map(F.lit, (".", "1", "2", "1/.", ".|2", "1/1/2", "0/0/."))), sq.zygosity).alias("z"),
        sq.read_blocks(F.lit(10), F.lit("2S3M2D4M1I5M10N2M")).alias("b"),
    ).first()
    assert (row.rc, row.gc, row.pad, row.w, row.k) == ("*NCAGT", 2, "NACGNN", ["ACGT", "TACG"], 2)
    assert [tuple(z) for z in row.z] == [(0, 0), (2, 1), (2, 1), (2, 1), (2, 1), (1, 1), (2, 0)]
    assert [tuple(b) for b in row.b] == [(10, 12, 3), (15, 18, 6), (19, 23, 11), (34, 35, 16)]
