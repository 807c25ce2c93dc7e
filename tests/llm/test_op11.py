import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from stranda.llm import op11_runs as op

RUNS = "start", "length", "period"


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k - p] for k in range(start + p, j)) for p in range(1, q)):
                found.append((start, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def texts():
    rng = random.Random(5)
    yield from (None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "é é é é é é", "a\x0bb\x0ca b a b a b")
    for size, alphabet in ((12, "ab"), (40, "ab"), (40, "abc"), (120, "ab"), (60, "a")):
        for _ in range(40):
            yield " ".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
    for _ in range(80):  # planted periods with some noise
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 20))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(9))] + (unit * 9)[: rng.randrange(3 * len(unit), 9 * len(unit))] + [rng.choice("abcd") for _ in range(rng.randrange(9))]
        if rng.random() < 0.3:
            text[rng.randrange(len(text))] = "x"
        yield " ".join(text)


def test_runs_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (3, "a a a a a a"), (None, "b " * 7)], "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n_words": F.lit("clash"), "collapsed": F.lit(1)})
    got = op.periodic_runs(df).collect()
    assert len(got) == len(rows) + 2
    want = {i: (t or "").split() for i, t in rows}
    for r in got:
        words = ["b"] * 7 if r.doc_id is None else want[r.doc_id]
        if r.doc_id == 3 and r.n_words == 6:
            words = ["a"] * 6
        runs = [tuple(x) for x in r.runs]
        assert runs == brute(words), words
        assert r.n_words == len(words) and r.collapsed.split() == collapse(words, runs)
    assert op.periodic_runs(df.limit(0)).count() == 0


def test_very_long_texts_take_linear_memory_and_no_quadratic_time(spark):
    phrase = " ".join(f"w{i}" for i in range(997))
    df = spark.createDataFrame([(1, "w " * 300_000), (2, (phrase + " ") * 200), (3, "a b " * 1000 + phrase + " c" * 6)], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in op.periodic_runs(df).collect()}
    assert got == {1: [(0, 300_000, 1)], 2: [(0, 997 * 200, 997)], 3: [(0, 2000, 2), (2997, 6, 1)]}


def test_diagonals_are_followed_for_one_lag_of_each_power_of_two():
    ids = np.array([0, 1, 0, 0, 1] * 9)
    word, lag, _ = op.matches(ids, np.zeros(len(ids), np.int64))
    pairs = list(zip(word.tolist(), lag.tolist()))
    assert pairs == sorted(set(pairs), key=lambda x: x[0]) and {5} <= set(lag.tolist()) and len(pairs) <= 4 * len(ids)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    assert oracle.compare(spark, op.op11_periodic_runs, op.ORACLE, f"/root/testdata/{sf}") == ""


def test_the_digests_follow_the_contract(spark):
    best = {}
    for r in op.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect():
        best[r.doc_id] = r
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for d in docs[:60]:
        words = [w.decode() for w in op.planted(d.doc_id, (d.text or "").encode().split())]
        if len(words) > 3000:
            continue
        runs, r = brute(words), best[d.doc_id]
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
