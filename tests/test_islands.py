"""Tiled interval operators against brute force, with intervals across many tiles."""

import random

from pyspark.sql import functions as F

from stranda.operators import islands


def test_tiles_change_nothing(spark):
    rng = random.Random(7)
    rows = [(f"c{rng.randrange(2)}", s, s + rng.choice((-1, 0, 3, 9, 60))) for s in (rng.randrange(1, 900) for _ in range(120))]
    df = spark.createDataFrame(rows, "chrom string, start_ long, end_ long")
    cover = {}
    for c, s, e in rows:
        for p in range(s, e + 1):
            cover[c, p] = cover.get((c, p), 0) + 1
    got = {(r.chrom, r.p): r.depth for r in islands.depth(df, tile=10).select("chrom", F.explode(F.sequence("start_", "end_")).alias("p"), "depth").collect()}
    assert got == cover
    for tile in (7, 1 << 16):
        merged = islands.merge(df, ["chrom"], adjacent=True, tile=tile).collect()
        assert {(r.chrom, p) for r in merged for p in range(r.start_, r.end_ + 1)} == set(cover)
        assert all((r.chrom, r.start_ - 1) not in cover and (r.chrom, r.end_ + 1) not in cover for r in merged)
        assert sum(r.n for r in merged) == sum(s <= e for _, s, e in rows)


def test_runs_across_tiles(spark):
    rows = [("a", 10 * i + 1, 10 * i + 10, None if i == 7 else float(i // 4)) for i in range(20) if i != 13]
    df = spark.createDataFrame(rows, "chrom string, start_ long, end_ long, value double")
    want = sorted(map(str, [("a", 1, 40, 0.0), ("a", 41, 70, 1.0), ("a", 71, 80, None), ("a", 81, 120, 2.0), ("a", 121, 130, 3.0), ("a", 141, 160, 3.0), ("a", 161, 200, 4.0)]))
    for tile in (15, 1000):
        assert sorted(str(tuple(r)) for r in islands.compact(df, tile).collect()) == want
    assert islands.compact(df.limit(0)).count() == islands.merge(df.limit(0), ["chrom"]).count() == islands.depth(df.limit(0)).count() == 0
