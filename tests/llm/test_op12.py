import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from stranda.llm import op12_lz as op

W = op.WINDOW


def brute(rows):
    """kept words and the number removed, in the order of rows; no doc_id comes last."""
    words = [(t or "").split() for _, t in rows]
    order = [op.LAST if i is None else i for i, _ in rows]
    least = {}
    for d, w in zip(order, words):
        for i in range(len(w) - W + 1):
            k = tuple(w[i : i + W])
            least[k] = min(least.get(k, d), d)
    out = []
    for (doc, _), d, w in zip(rows, order, words):
        gone = {i + k for i in range(len(w) - W + 1) if least[tuple(w[i : i + W])] < d for k in range(W)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in op.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def texts(rng):
    word = lambda: f"w{rng.randrange(500)}"
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 75, 200)]
    base = fresh(300)
    for _ in range(60):  # passages amid other words, some twice, some next to each other
        yield fresh(rng.randrange(60)) + rng.choice(passages) + fresh(rng.randrange(3)) + rng.choice(passages)[rng.randrange(10) :] + fresh(rng.randrange(60))
    for _ in range(40):  # near copies
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(300)] = word()
        yield copy[rng.randrange(30) : 300 - rng.randrange(30)]
    yield from (base, base, ["a"] * 400, ["a"] * 120, ["b"] * 49, ["b"] * 50, ["b"] * 51, ["a", "b"] * 90, ["b", "a"] * 90, passages[4][100:] + passages[4][:100])


def test_rows_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts(rng))]
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "é\x0b🙂 x"), (None, rows[0][1]), (None, "n " * 80), (None, "n " * 80), rows[5], (rows[5][0], "another text " * 60), (950, "another text " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit("clash"), "windows": F.lit(1), "anchor": F.lit("x")})
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"x{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[150_000:150_080])), (3, " ".join(["y"] + long[:100_000] + ["z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[2] for r in sorted(got(df))] == [0, 80, 100_000]


def test_blocks_cover_all_windows_and_are_cut_by_content():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    seeds = op.grams(h, op.SEED)
    at = op.leftmost_least(seeds, W - op.SEED + 1)
    for i in range(400 - W + 1):
        part = seeds[i : i + W - op.SEED + 1]
        assert at[i] == i + int(np.argmin(part))
    assert (op.grams(h[7:], W) == op.grams(h, W)[7:]).all() and len(set(op.grams(h, W).tolist())) == 400 - W + 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    assert oracle.compare(spark, op.op12_relative_lz, op.ORACLE, f"/root/testdata/{sf}") == ""
