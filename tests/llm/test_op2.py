import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stranda.llm import op2_kdtree as op


def check(docs, rows, shards):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, weight = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    return weight


def test_query_has_near_equal_bytes(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = op.op2_kdtree(spark, "/root/testdata/sf0.01").collect()
    weight = check(docs, rows, 16)
    most = max(r["size"] for r in rows)
    assert len(weight) == 16 and max(weight.values()) - min(weight.values()) <= 2 * most
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_copies_are_split_only_where_they_are_many(spark):
    docs = [(i, "same text for all of these") for i in range(4000)] + [(10000 + i, f"text number {i // 2}") for i in range(6000)]
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], "doc_id long, text string, lang string, source string").withColumn("c", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("size", F.lit(1))
    rows = op.partition(df).collect()
    weight = check(docs, rows, 16)
    assert max(weight.values()) <= 1.05 * min(weight.values())
    pairs = defaultdict(set)
    for r in rows:
        if r.doc_id >= 10000:
            pairs[(r.doc_id - 10000) // 2].add(r.shard)
    assert all(len(x) == 1 for x in pairs.values())


def test_nulls_repeats_and_empty(spark):
    docs = [(None, "a"), (None, "a"), (1, None), (1, None), (2, ""), (3, "é" * 1000), (-(2**63), "x"), (2**63 - 1, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for shards in (1, 2, 16):
        check(docs, op.partition(df, shards).collect(), shards)
    assert op.partition(df.limit(0)).count() == 0
