import hashlib
import re

from pyspark.sql import functions as F

from stranda.llm import op8_pii as op


def brute(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


ODD = [
    None, "", "a@b.c@d.e a@b.c_x@d.e @x.y é🙂q@w.e.r..t %+@-.- a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.255.256 1.2.3.004 9.9.9",
    "4111 1111-1111 1111 4111111111111111 4111111111111112 41111111111111110000 4111  1111 6011000990139424x378282246310005",
    "12-4111111111111111 4111 1111 1111 1111-", "+1 (743) 555-3824 +12 +1.2.3.4.5.6.7.8 ++1234567890-- +1((((2 +123456789012345678",
    "+4111111111111111@x.com 10.0.0.1@host.org", "7 " * 2000 + "4111111111111111 +1 (743) 555-3824",
]


def test_base_spans_equal_brute_force(spark):
    docs = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("base", F.lit("clash")).drop("base")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in op.base_spans(df).collect()}
    for d, t in docs:
        assert got[d] == brute(t or ""), (d, t, got[d], brute(t or ""))


def test_query_keeps_base_spans_and_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op.op8_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        line = ",".join(":".join(map(str, s)) for s in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line)
        assert [r[f"n_{k}"] for k in op.BASE] == [sum(s[0] == k for s in want) for k in op.BASE]


def test_prefix_sums_beyond_a_block(spark):
    n = 3 * 256 + 5
    got = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>").alias("s")).select(op._prefix(F.col("s")).alias("p")).first().p
    assert got == [i * (i + 1) // 2 for i in range(n)]


def test_trees_find_the_separating_feature_and_thresholds_hold():
    x = lambda g, d: (g, d, *[0] * 11)
    cells = [(x(0, 1), 0, 500), (x(0, 5), 490, 500), (x(1, 5), 0, 500), (x(1, 1), 10, 500)]
    trees = op.Trees(cells)
    assert trees.score(x(0, 5)) > 0 > max(trees.score(x(0, 1)), trees.score(x(1, 5)), trees.score(x(1, 1)))
    least = op.thresholds([(trees.score(x), x[0], p, t) for x, p, t in cells])
    assert set(least) == {0} and 0 <= least[0] <= trees.score(x(0, 5))


SECRETS = (r"\bAKIA[A-Z0-9]{16}\b", r"(?<=password=)[0-9a-f]+", r"(?<=token = \")[0-9a-f]+")  # the forms that are planted in the table


def test_added_spans_are_the_planted_secrets(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = {(d, m.start(), m.end()) for d, t in docs.items() for p in SECRETS for m in re.finditer(p, t or "")}
    rows = op.op8_pii(spark, "/root/testdata/sf0.01").collect()
    got = {(r.doc_id, int(a), int(z)) for r in rows for k, a, z in (s.split(":") for s in r.spans.split(",") if s) if k not in op.BASE}
    assert sum(r.n_added for r in rows) == len(got) > 0
    assert len(want & got) >= 0.95 * len(want) and len(want & got) >= 0.95 * len(got), (sorted(want - got)[:5], sorted(got - want)[:5])


def test_long_values_and_many_spans(spark):
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(40))
    many = " ".join(f"u{i}@mail.com 10.0.{i % 250}.{i % 99} +1 555 {1000000 + i} n" for i in range(5000))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, f'x secret: "{long}" y'), (-2, many), (-3, " " * 100_000)], "doc_id long, text string"))
    got = {r.doc_id: r.text for r in op.redact(docs).filter("doc_id < 0").collect()}
    assert got[-1] == 'x secret: "[SECRET]" y' and got[-2] == " ".join(["[EMAIL] [IP] [PHONE] n"] * 5000) and got[-3] == " " * 100_000


def test_redaction_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "x a@b.co y 10.0.0.1@host.org"), (1, "x a@b.co y 10.0.0.1@host.org"), (None, "none"), (2, None), (3, "")], "doc_id long, text string").withColumn("spans", F.lit("own")).withColumn("found", F.lit(7)).withColumn("_m", F.lit(1)).withColumn("row", F.lit(2))
    out = op.redact(docs)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text), r.spans, r.found) for r in out.collect())
    assert got == sorted([("1", "x [EMAIL] y [EMAIL]", "own", 7)] * 2 + [("None", "none", "own", 7), ("2", "None", "own", 7), ("3", "", "own", 7)])
    assert op.redact(docs.limit(0)).count() == 0


def test_all_texts_and_words_are_learned_from(spark, monkeypatch):
    """Every candidate and ordinary word of more texts than a sample would take is counted once for each distinct text."""
    seen = []

    class Spy(op.Trees):
        def __init__(self, cells):
            seen.append(cells)
            super().__init__(cells)

    monkeypatch.setattr(op, "Trees", Spy)
    n = 30_000
    text = F.concat(F.lit("completely ordinary sentence about numbers "), F.col("id") + 55_500_000)
    docs = spark.range(n).select(text.alias("text"))
    op.train(docs.unionByName(docs.limit(500)))
    last = seen[-1] if len(seen) == op.FOLDS + 1 else sum(seen[-len(op.KINDS) :], [])  # trees of all kinds, or of each
    totals = [sum(t for x, _, t in last if x[0] == kind) for kind in range(len(op.KINDS))]
    assert totals == [n, 0, 3 * n]
