import pytest

from stranda.operators import alignments, genome
from stranda.operators import reads as ops
from stranda.sources import text

READS = "name string, chrom string, strand string, blocks array<struct<start_: long, end_: long>>, seq string, mm array<struct<off: int, alt: string>>"


def test_reads_of_blocks(spark):
    chunks = genome.chunked(spark.createDataFrame([("1", 0, "ACGTACGTAC")], "chrom string, at long, seq string"), 4)
    rows = [("a", "1", "-", [(7, 8), (2, 4)], None, [(0, "G"), (4, "N")]), ("b", "1", "+", [(9, 12)], None, None), ("c", "2", "+", [(1, 2)], "TT", [])]
    got = {r.name: r for r in alignments.built(spark.createDataFrame(rows, READS), chunks, 4).collect()}
    assert (got["a"].start_, got["a"].end_, got["a"].cigar, got["a"].seq, got["a"].flag) == (2, 8, "3M2N2M", "GGTGN", 16)
    assert (got["b"].seq, got["b"].qual, got["b"].mapq, got["b"].tags) == ("ACNN", "~~~~", 255, {}) and got["c"].seq == "TT"
    lines = text.sam_lines(alignments.built(spark.createDataFrame(rows[2:], READS)))
    assert lines.first().value == "c\t0\t2\t1\t255\t2M\t*\t0\t0\tTT\t~~"
    assert alignments.built(spark.createDataFrame([], READS), chunks, 4).count() == 0


@pytest.mark.parametrize(
    "row, message",
    [
        (("a", "1", None, [(1, 2)], "AA", None), "no blocks or strand"),
        (("a", "1", "+", [], "", None), "no blocks or strand"),
        (("a", "1", "+", [(1, 4), (4, 5)], "AAAAAA", None), "blocks overlap"),
        (("a", "1", "+", [(1, 4)], "AAA", None), "does not fit"),
        (("a", "1", "+", [(1, 4)], None, None), "does not fit"),
        (("a", "1", "+", [(1, 4)], "AAAA", [(4, "C")]), "does not fit"),
    ],
)
def test_reads_that_cannot_be(spark, row, message):
    with pytest.raises(Exception, match=message):
        alignments.built(spark.createDataFrame([row], READS)).select("cigar").collect()


def test_tags_of_conversions(spark):
    found = spark.createDataFrame([("a", 0, "T", "C", 9), ("a", 0, "T", "C", 2), ("a", 0, "T", "T", 3), ("b", 16, "A", "A", 1), ("c", 128, "A", "G", 0), ("d", 0, "G", "G", 5)], "uid string, flag int, ref string, alt string, offset int")
    got = {r.uid: tuple(r)[1:] for r in ops.tag_tc(found, ["uid"]).collect()}
    assert got == {"a": (3, 2, "2,9", "85,0,0"), "b": (1, 0, "", None), "c": (1, 1, "0", "0,0,0"), "d": (0, 0, "", None)}
    assert ops.tag_tc(found.drop("offset"), ["uid"]).columns == ["uid", "xt", "xc"]
