"""Each stage against a brute-force version on what its predecessor left."""

import os
import sys

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_near_copies  # noqa: E402
import test_op6  # noqa: E402
import test_op8  # noqa: E402
import test_op10  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_copies", "benchmark_leaks", "personal_data", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    def run(name):
        nonlocal left
        left = corpus_pipeline.stored(stages[name](spark, left, SF))
        assert name == "packing" or left.columns == columns
        return left.collect()

    got = run("language")
    assert len(got) >= 0.95 * len(rows) and all(rows[r.doc_id] == r for r in got)
    before = [(r.doc_id, r.text) for r in got]
    got = run("near_copies")
    assert sorted(r.doc_id for r in got) == test_near_copies.brute(before)
    before = [(r.doc_id, r.text) for r in got]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = run("benchmark_leaks")
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, hit, _ in test_op6.brute(before, items) if not hit)
    before = {r.doc_id: r.text for r in got}
    got = run("personal_data")
    for r in got:
        spans = test_op8.brute(before[r.doc_id])
        assert r.n_chars == len(r.text) and not test_op8.brute(r.text)
        assert sum(r.text.count(f"[{k.upper()}]") for k in ("email", "ip", "card", "phone")) >= bool(spans)
    assert len(got) == len(before)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    texts = [(r.doc_id, r.text) for r in got]
    test_op10.check(run("packing"), texts, want)


def test_odd_rows_pass_through_all_stages(spark):
    """Nulls, empty and repeated rows, odd column names; an empty table."""
    some = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "12 34", None, None, None)], some.schema)
    docs = some.unionByName(odd).withColumns({"_d": F.lit(1), "_m": F.lit(2), "row": F.lit(3), "key": F.lit(4), "spans": F.lit(5), "root": F.lit(6)})
    for left in (docs, docs.limit(0)):
        n = left.count()
        for name, stage in corpus_pipeline.STAGES:
            left = corpus_pipeline.stored(stage(spark, left, SF))
            assert name == "packing" or (left.columns == docs.columns and left.count() <= n)
        assert (left.count() > 0) == (n > 0)
