import re

from pyspark.sql import functions as F

from stranda.llm import op1_rules as op

ODD = [
    None, "", " \n\t", "one", "a b c d e f g h " * 6, "# * $ % & | < > " * 5, "same line here\n" * 9, "x" * 200_000, "w " * 100_000, "é🙂 ÀB c " * 12, "THE CAPS ARE ALL OVER THIS TEXT " * 4,
    " ".join(f"word{i}" for i in range(40)), "go go go go stop " * 9, "a\r\nb\n\n \na\n",
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))


def frame(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "n_words": F.lit("clash"), "fail_bits": F.lit(1)})


def test_measures_equal_brute_force(spark):
    got = op.apply_policy(op.ledger(frame(spark))).collect()
    key = lambda x: tuple(map(str, x))
    want = [(i, *brute(t)) for i, t in enumerate(ODD)] + [(3, *brute("one")), (None, *brute("no id"))]
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.fail_bits & op.mask("2") == 0) and not (r.kept and r.base_failed) for r in got)
    assert op.apply_policy(op.ledger(frame(spark).limit(0))).count() == 0


def test_a_policy_and_its_ablations_come_from_the_bits_alone(spark):
    ledger = op.ledger(frame(spark)).cache()
    bits = [r.fail_bits for r in ledger.collect()]
    for policy in op.POLICIES:
        base = op.mask("1") | op.mask(policy)
        assert sum(r.kept for r in op.apply_policy(ledger, policy).collect()) == sum(b & base == 0 for b in bits)
        m = op.mask(policy)
        want = {name: (sum(b & op.bit(name) != 0 for b in bits), sum(b & m == op.bit(name) for b in bits)) for name in op.POLICIES[policy]}
        assert {r.rule: (r.n_failed, r.n_only) for r in op.ablations(ledger, policy).collect()} == want
