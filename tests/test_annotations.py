import os

from pyspark.sql import functions as F

from stranda.operators import annotations as an
from stranda.operators import islands

S = "feature_type string, id string, chrom string, start_ long, end_ long, strand string, attrs map<string,string>"


def test_annotations_are_merged_by_key(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [("gene", f"g{i}", "c", i, i + 5, "+" if i % 2 else None, {"x": f"x{i}", "y": "old", "dna_seq": "ACGT"}) for i in range(40)]
    features = spark.createDataFrame(rows, S)
    an.save(an.of_features(features), path)
    got = {r.id: r.annotations for r in an.annotate(features, an.load(spark, path)).collect()}
    assert got["g3"] == {"x": "x3", "y": "old"} and len(got) == 40
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    before = files()
    new = features.filter("id = 'g3'").select(an.key().alias("key"), F.lit("y").alias("name"), F.lit("new").alias("value"))
    an.merge(spark, path, new, update=True)
    spark.catalog.refreshByPath(path)
    got = {r.id: r.annotations for r in an.annotate(features, an.load(spark, path)).collect()}
    assert got["g3"] == {"x": "x3", "y": "new"} and got["g4"] == {"x": "x4", "y": "old"}
    assert len(before - files()) == 1 and len(files() - before) == 1
    an.merge(spark, path, new)
    spark.catalog.refreshByPath(path)
    got = {r.id: r.annotations for r in an.annotate(features, an.load(spark, path)).collect()}
    assert got["g3"] == {"y": "new"} and got["g5"] == {"x": "x5", "y": "old"}
    assert an.unknown(features.filter("id <> 'g7'"), an.load(spark, path)).count() == 1


def test_neighbours_equal_those_of_one_sort(spark):
    rows = [(i, f"c{i % 3}", s := (i * 7919) % 997, s + i % 40) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, chrom string, start_ long, end_ long")
    names = ["c2", "c0", "c1"]
    order = sorted(rows, key=lambda r: (names.index(r[1]), r[2], r[3], r[0]))
    for tile, dist in ((10, None), (100, 3), (1 << 16, 0)):
        got = {r.id: (r.prev, r.next) for r in islands.neighbours(df, "g", names, dist, tile).collect()}
        for i, r in enumerate(order):
            want = []
            for n in (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None):
                near = n and (dist is None or n[1] == r[1] and max(0, n[2] - r[3], r[2] - n[3]) <= dist)
                want.append(n[0] if near else None)
            assert got[r[0]] == tuple(want)
