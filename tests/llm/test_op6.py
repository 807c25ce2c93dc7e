import re

from pyspark.sql import functions as F

from stranda.llm import op6_decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for g, owners in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= owners
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


BENCH = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "short Item"), (2, "ÉTÉ"), (3, None), (4, " .,"), (5, "short item"), (6, "x y x y")]
LONG = "one TWO three-four five six seven eight nine ten ELEVEN twelve"
DOCS = [(1, f"before {LONG} after"), (2, "a short item, and a Short.Item"), (3, "été ÉTÉ"), (4, None), (5, ""), (6, "clean words only"), (6, "short item"), (7, "x y x y x y x"), (8, "one two three four five six seven eight nine"), (None, "short item"), (9, "word " * 5000 + LONG), (9, "word " * 5000 + LONG)]


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in df.collect()), key=str)


def test_both_ways_equal_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("n", F.lit("clash"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted(brute(DOCS, BENCH), key=str)
    assert rows(op.scan(docs, bench)) == want
    assert rows(op.scan(docs, bench, in_set=1)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert op.scan(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in op.scan(docs, bench.limit(0)).collect()} == {0}


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("w", F.lit(1))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    left = op.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in left.collect()) == sorted(["4None", "5", "6clean words only", "8one two three four five six seven eight nine"])
    cut = {(r.doc_id, r.text) for r in op.clean(docs, bench, "spans").collect()}
    assert (1, "before after") in cut and (2, "a, and a") in cut and (4, None) in cut and (6, "") in cut
