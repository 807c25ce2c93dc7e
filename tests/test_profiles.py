import hashlib
from collections import Counter

from stranda.operators import reads as ops

# position 1: 12 bases, one off; 2: 11, of which 2 off (a SNP at a tenth); 3: 10 (too few); 4: 20, one deleted, one N
COLUMNS = {1: ("A", {("A", "+"): 11, ("C", "-"): 1}), 2: ("C", {("C", "+"): 9, ("T", "+"): 2}), 3: ("G", {("G", "-"): 10}), 4: ("T", {("T", "-"): 18, ("-", "+"): 1, ("N", "+"): 1})}


def found(spark):
    rows = [("c", pos, ref, alt, strand) for pos, (ref, counts) in COLUMNS.items() for (alt, strand), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, strand string")


def test_columns_by_coverage_and_share_of_mismatches(spark):
    kinds = {r.pos: r.kind for r in ops.pileup_columns(found(spark)).withColumn("kind", ops.column_kind()).collect()}
    assert kinds == {1: "analysed", 2: "snp", 3: "lowcov", 4: "analysed"}
    regions = spark.createDataFrame([(1, "c", 1, 4), (2, "c", 4, 9), (3, "d", 1, 4)], "id long, chrom string, start_ long, end_ long")
    rows = ops.region_profiles(found(spark), regions, "id").collect()
    columns, counts = Counter(), {}
    for r in rows:
        columns[r.id, r.kind] += r.columns
        if r.alt:
            counts[r.id, r.ref, r.alt, r.strand] = r.n
    assert columns == {(1, "analysed"): 2, (1, "snp"): 1, (1, "lowcov"): 1, (2, "analysed"): 1}
    assert counts == {(1, "A", "A", "+"): 11, (1, "A", "C", "-"): 1, (1, "T", "T", "-"): 18, (2, "T", "T", "-"): 18}
    one = {(r.ref, r.alt, r.strand): r.n for r in ops.profile_counts(ops.region_profiles(found(spark), regions, "id", stranded=False)).collect()}
    assert one == {("A", "A", "+"): 11, ("A", "C", "+"): 1, ("T", "T", "+"): 36}
    assert {r.strand: (r.n, r.mismatches) for r in ops.mismatch_rates(ops.profile_counts(ops.region_profiles(found(spark), regions, "id"))).collect()} == {"+": (11, 0), "-": (37, 1)}


def test_regions_are_taken_in_a_fixed_order_until_enough(spark):
    off = {i: i % 4 for i in range(300)}
    profiles = spark.createDataFrame([(i, "analysed", "A", alt, "+", n, 1) for i, m in off.items() for alt, n in (("A", 5), ("C", m)) if n], "id long, kind string, ref string, alt string, strand string, n long, columns long")
    for most in (0, 1, 50, 449, 450, 10_000):
        want, done = set(), 0
        for i in sorted(off, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            if done >= most:
                break
            want.add(i)
            done += off[i]
        assert {r.id for r in ops.sampled_regions(profiles, "id", most).collect()} == want


def test_listed_positions_without_reads_are_empty(spark):
    at = spark.createDataFrame([("c", 1), ("c", 1), ("c", 7), ("d", 1)], "chrom string, pos long")
    assert {(r.chrom, r.pos): (r.total, r.counts) for r in ops.pileup_at(found(spark), at).collect()} == {("c", 1): (12, {"A": 11, "C": 1}), ("c", 7): (0, {}), ("d", 1): (0, {})}
