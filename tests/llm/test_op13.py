import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import oracle
from stranda.llm import op13_trie as op

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in by.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + t[h:]
    return out


def brute(rows):
    convs = conversations(rows)
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        saves, leaves = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0), 0 if k in kids else 1
        for x in kids.get(k, []):
            s, n = below(x)
            saves, leaves = saves + s, leaves + n
        return saves, leaves

    out = []
    for k, m in members.items():
        saves, leaves = below(k)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves, saves, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in op.trie(op.rebuilt(op.turns(df))).collect()), key=str)


def test_nodes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no é🙂", ""])) for c in range(250) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "same") for c in range(1000, 1150) for t in range(7)]  # copies of one conversation, over a boundary of heads
    rows += [(777, None, None, None), (777, 0, "user", None), (777, 0, "user", None), (777, 1, "b", "x"), (777, 1, "a", "x"), (None, 0, "user", "no id"), (555, 0, "user", "one row")]
    rows += [(2**33 + 1, 0, "user", "w " * 200_000), (2**33 + 1, 1, "user", "after"), (9000, 0, "a", "bc"), (9100, 0, "ab", "c")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "h": F.lit(1), "at": F.lit("x")})
    assert got(df) == brute(rows)


def test_long_conversations_and_no_conversation(spark):
    rows = [(c, t, "user", f"turn {t if t < 2000 + c else -c}") for c in (0, 100, 200) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(df)
    assert len(out) == 3001 + 1000 + 900
    roots = [x for x in out if x[1] == 0]
    assert len(roots) == 1 and roots[0][3] == 3 and roots[0][5] == 3
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []


def test_conversations_without_turns_end_at_the_root(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6][:3]
    rows = [(c, 0, "user", "only") for c in short]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert len(brute(rows)) == 1


def test_end_lists_join_ranges_in_numerical_order(spark):
    ids = [5, 12, 4096, 4097, 9000, 100_000, 99_999]
    found = spark.createDataFrame([(c, 1, 7, 7, True) for c in ids], "conv_id long, depth long, z1 long, z2 long, ends boolean")
    assert [r.ends_sha256 for r in op.end_lists(found).collect()] == [hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    assert oracle.compare(spark, op.op13_prefix_trie, op.ORACLE, f"/root/testdata/{sf}") == ""
