import random
import re

from pyspark.sql import functions as F

from stranda.llm import op4_ngram_join as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, least=90):
    sets = {}
    for d, t in docs:
        sets.setdefault(frozenset(shingles(t)), []).append(d)
    keys = [k for k in sets if k]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by_token = {}
    for k in keys:
        for s in k:
            by_token.setdefault(s, []).append(k)
    seen = set()
    for group in by_token.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if 100 * min(len(a), len(b)) >= least * max(len(a), len(b)) and (id(a), id(b)) not in seen:
                    seen.add((id(a), id(b)))
                    if 100 * len(a & b) >= least * len(a | b):
                        root[find(a)] = find(b)
    best = {}
    for k in keys:
        best[find(k)] = min([*sets[k], best.get(find(k), sets[k][0])])
    return sorted((d, len(shingles(t)), best[find(frozenset(shingles(t)))] if shingles(t) else d) for d, t in docs)


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows(op.op4_ngram_join(spark, "/root/testdata/sf0.001")) == brute(docs)


def test_near_copies_of_one_text_and_of_each_other(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(100)]
    docs = [(500, " ".join(base))]
    for i in range(60):  # each near the base alone
        w = list(base)
        w[rng.randrange(100)] = f"new{i}"
        docs.append((i + 1, " ".join(w)))
    w = [f"v{i}" for i in range(200)]
    for i in range(40):  # a chain
        w = list(w)
        w[5 * i] = f"link{i}"
        docs.append((1000 - i, " ".join(w).upper()))
    common = " ".join(f"p{i}" for i in range(60))  # a passage that many share
    docs += [(2000 + i, common + " " + " ".join(f"q{i}x{j}" for j in range(30))) for i in range(50)]
    docs += [(3000, "a b c d e f g h i j k"), (3001, "a b c d e f g h i j k l"), (3002, "A\tb"), (3003, "a b"), (3004, "a"), (3005, None), (3006, ""), (3007, " \n"), (3008, "a b\x85c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("token", F.lit(0))
    assert rows(op.join_components(df)) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "A B C"), (4, "other text here"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.join_components(docs).collect()), key=str)
    assert got == sorted([(None, 1, None), (5, 1, 4), (5, 1, 4), (4, 1, 4), (4, 1, 4), (None, 0, None)], key=str)
    assert op.join_components(docs.limit(0)).count() == 0
