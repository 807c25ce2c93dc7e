"""The stage near_copies against a brute-force version of five-word shingles and a Jaccard of 0.8."""

import os
import random
import sys

import corpus_pipeline

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_op4  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(docs, size=5, least=0.8):
    """The ids that stay: of each component the least."""
    sets = {d: test_op4.shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(d for d in sets if find(d) == d)


def edited(words, kind):
    w = list(words)
    if kind == "block":
        w[400:460] = [f"block{i}" for i in range(60)]
    elif kind == "scattered":
        for i in range(20):
            w[50 * i + 7] = f"edit{i}"
    else:
        w += [f"more{i}" for i in range(150)]
    return w


def test_edits_that_three_words_at_90_percent_miss(spark):
    rng, docs = random.Random(3), []
    for i, kind in enumerate(("block", "scattered", "appended")):
        base = [f"{kind}{rng.randrange(5000)}" for _ in range(1000)]
        docs += [(10 * i + 1, " ".join(base)), (10 * i + 2, " ".join(edited(base, kind)))]
    docs.append((99, " ".join(f"other{i}" for i in range(500))))
    assert test_op4.brute(docs) == [(d, n, d) for d, n, _ in test_op4.brute(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, SF).collect()) == brute(docs) == [1, 11, 21, 99]


def test_stage_on_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, SF).collect()) == want


def test_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    near = a + " end"
    docs = [(1, a), (1, b), (1, b), (2, near), (2, "c d e f g h"), (None, near), (None, "x y z"), (None, "x y z"), (3, ""), (3, ""), (3, None), (None, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, df, SF)
    want = [(1, a), (1, b), (2, "c d e f g h"), (None, "x y z"), (3, ""), (3, None), (None, None), (None, None)]
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
