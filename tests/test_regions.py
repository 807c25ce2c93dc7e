import random

import pytest
from pyspark.sql import functions as F

from stranda.operators import joins
from stranda.sources import regions

S = "uid long, chrom string, start_ long, end_ long, strand string"


def intervals(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-50, 200_000)
        out.append((i, rng.choice(["a", "b"]), start, start + int(longest ** rng.random()) - 2, rng.choice(["+", "-", None])))
    return out


def overlap(x, y):
    return x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3]


@pytest.mark.parametrize("longest", [(40, 40), (150_000, 30), (30, 150_000), (150_000, 150_000)])
def test_pairs_of_mixed_lengths_equal_all_pairs(spark, longest):
    left, right = intervals(1, 300, longest[0]), intervals(2, 300, longest[1])
    a, b = spark.createDataFrame(left, S), spark.createDataFrame(right, S)
    for size in (8, 64):
        got = [tuple(r) for r in joins.overlap_pairs(a, b, size).select("uid", "r_uid").collect()]
        assert sorted(got) == sorted((x[0], y[0]) for x in left for y in right if overlap(x, y))
    has = {x[0] for x in left if any(overlap(x, y) for y in right)}
    assert {r.uid for r in joins.matched(a, b, "left_semi", ["uid"]).collect()} == has
    assert {r.uid for r in joins.matched(a, b, "left_anti", ["uid"]).collect()} == {x[0] for x in left} - has
    near = [tuple(r) for r in joins.overlap_pairs(a, b, within=500, stranded=True).select("uid", "r_uid").collect()]
    wide = lambda x: (*x[:2], x[2] - 500, x[3] + 500)
    assert sorted(near) == sorted((x[0], y[0]) for x in left for y in right if x[2] <= x[3] and overlap(wide(x), y) and x[4] == y[4])


def test_rows_of_an_interval_are_bounded_by_the_levels(spark):
    genes = spark.createDataFrame([(1, "a", 10, 2_300_000, None), (2, "a", 5, 9, None)], S)
    a, b, _ = joins._meeting(genes, genes, joins.BIN)
    assert max(r["count"] for r in a.groupBy("uid").count().collect()) <= 2 * joins.LEVELS
    assert max(r["count"] for r in b.groupBy("r_uid").count().collect()) <= 2 * joins.LEVELS


def test_empty_sides(spark):
    some, none = spark.createDataFrame([(1, "a", 10, 20, None)], S), spark.createDataFrame([], S)
    assert joins.overlap_pairs(some, none).count() == joins.overlap_pairs(none, some).count() == 0
    assert joins.matched(some, none, "left_anti", ["uid"]).count() == 1


def test_sides_are_annotated_under_their_own_label(spark):
    left = spark.createDataFrame([(1, "a", 10, 20, "+"), (2, "b", 10, 20, "-"), (3, "c", 1, 5, "+"), (4, "a", 9, 8, "+")], S)
    genes = spark.createDataFrame([("g1", "a", 1, 10, "-"), ("g2", "a", 15, 15, "+"), ("g0", "a", 1, 10, "+")], "name string, chrom string, start_ long, end_ long, strand string")
    peaks = spark.createDataFrame([(0.5, "b", 20, 90, None), (1.5, "zz", 1, 9, None)], "value double, chrom string, start_ long, end_ long, strand string")
    out = {r.uid: r for r in joins.annotate_sides(left, {"gene": genes, "peak": peaks, "nothing": genes.limit(0)}, ["uid"]).collect()}
    assert [(m.name, m.start_) for m in out[1].gene] == [("g0", 1), ("g1", 1), ("g2", 15)] and out[1].peak == out[1].nothing == []
    assert out[2].gene == [] and [m.value for m in out[2].peak] == [0.5]
    assert out[3].gene == out[3].peak == out[4].gene == []
    one = {r.uid: [m.name for m in r.gene] for r in joins.annotate_sides(left, {"gene": genes, "peak": peaks}, ["uid"], stranded=True).collect()}
    assert one[1] == ["g0", "g2"]


def test_region_texts():
    of = regions.Region.of
    assert of("chr1") == ("chr1", None, None) and of("chr1:1,000-2,000") == ("chr1", 1000, 2000) and of("x:5") == ("x", 5, 5) and of(None) == (None, None, None)
    for bad in ("", "chr1:", "chr1:a-b", "a:1-2-3"):
        with pytest.raises(ValueError):
            of(bad)
    with pytest.raises(ValueError):
        of("chr9").known({"chr1"})


def test_tsv_with_any_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#head\nx\t1\t9\t20\nx\t2\t0\t5\n\nbad line\nx\tchrM\t7\tNA\n")
    get = lambda **k: [(r.chrom, r.start_, r.end_, r.fields[0]) for r in regions.read_tsv(spark, str(tmp_path / "t.tsv"), columns=(1, 2, 3), shift=(1, 0), **k).collect()]
    assert get() == [("1", 10, 20, "x"), ("2", 1, 5, "x")]
    assert get(alias={"1": "chr1"}, region="chr1:20-30") == [("chr1", 10, 20, "x")]
    assert get(region="1:21-30") == []


def test_a_region_reads_few_files_of_a_stored_table(spark, tmp_path):
    rows = intervals(5, 800, 150_000) + [(900, None, 5, 9, None), (901, "a", 30, 29, None)]
    df, path = spark.createDataFrame(rows, S), str(tmp_path / "t")
    regions.store(df, path, bin_size=1000)
    assert sorted(map(str, regions.scan(spark, path, bin_size=1000).collect())) == sorted(map(str, df.collect()))
    for text in ("a", "a:5000-5200", "b:1-1", "b:100000-190000", "zz:1-5"):
        at = regions.Region.of(text)
        want = sorted(x[0] for x in rows if x[1] == at.chrom and x[2] <= x[3] and (at.start is None or x[2] <= at.end and x[3] >= at.start))
        assert sorted(r.uid for r in regions.scan(spark, path, text, 1000).collect()) == want, text
    few = regions.scan(spark, path, "a:5000-5200", 1000)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    read = few.select("uid", F.input_file_name().alias("f")).select("f").distinct().count()
    assert read < spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count() / 5
