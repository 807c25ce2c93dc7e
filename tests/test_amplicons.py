import hashlib
import random

from pyspark.sql import functions as F

from stranda.operators import amplicons, genome

RNG = random.Random(3)
SEQS = {"c1": "".join(RNG.choice("ACGT") for _ in range(300)), "c2": "".join(RNG.choice("ACGT") for _ in range(90))}


def brute(rows, padding, extension):
    """Pieces and places by a loop over sorted intervals."""
    ext = sorted((c, max(1, s - extension), e + extension, f"{n or 'None'}_{c}_{s}_{e}", s, e) for c, s, e, n in rows if c in SEQS and s <= e)
    pieces = []
    for c, b, u, label, s, e in ext:
        if pieces and pieces[-1][0] == c and b <= pieces[-1][2]:
            pieces[-1][2] = max(pieces[-1][2], u)
            pieces[-1][3].append((b, u, label))
            pieces[-1][4].append((s, e))
        else:
            pieces.append([c, b, u, [(b, u, label)], [(s, e)]])
    out, at = set(), []
    for c, b, u, labels, members in pieces:
        name = "+".join(x[2] for x in sorted(set(labels)))
        seq = "N" * padding + SEQS[c][b - 1 : u] + "N" * padding
        out.add((name, c, b, u, len(members), seq, len(seq), hashlib.md5(seq.encode()).hexdigest()))
        at += [(name, s, e, padding + s - b + 1, padding + e - b + 1) for s, e in members]
    return out, sorted(at)


def chunks(spark):
    return genome.chunked(spark.createDataFrame([(c, 0, s) for c, s in SEQS.items()], "chrom string, at long, seq string"), 32)


def test_pieces_and_places_equal_a_loop(spark):
    rows = [("c1", 1, 10, "a"), ("c1", 1, 10, "a"), ("c1", 20, 30, None), ("c1", 41, 50, "b+"), ("c1", 72, 80, "d"), ("c1", 290, 299, "e"), ("c2", 85, 95, "f"), ("c2", 60, 50, "empty"), ("c2", 200, 210, "far"), ("c9", 1, 5, "nowhere")]
    rows += [(c, s, s + RNG.randrange(12), f"r{i}") for i in range(12) for c, s in [(RNG.choice(["c1", "c2"]), RNG.randrange(1, 280))]]
    df = spark.createDataFrame(rows, "chrom string, start_ long, end_ long, name string")
    for padding, extension in ((0, 0), (5, 10), (3, 40)):
        made = amplicons.build(df, chunks(spark), padding, extension, 32)
        pieces, places = brute(rows, padding, extension)
        assert {tuple(r) for r in made.pieces.collect()} == pieces
        assert sorted((r.amplicon, r.start_, r.end_, r.rel_start, r.rel_end) for r in made.mapped.collect()) == places


def test_intervals_that_share_no_base_stay_apart(spark):
    df = spark.createDataFrame([("c1", 20, 29, "a"), ("c1", 50, 59, "b"), ("c1", 79, 80, "c")], "chrom string, start_ long, end_ long, name string")
    assert sorted(r.amplicon for r in amplicons.build(df, chunks(spark), 0, 10, 32).pieces.collect()) == ["a_c1_20_29", "b_c1_50_59+c_c1_79_80"]


def test_places_hold_the_bases_of_their_intervals_and_extra_columns_stay(spark):
    df = spark.createDataFrame([("c1", 33, 70, "a", 1.5, "-", "x", "y"), ("c1", 100, 101, "b", None, None, "z", None)], "chrom string, start_ long, end_ long, name string, score double, strand string, group_start string, label string")
    made = amplicons.build(df, chunks(spark), 7, 9, 32)
    both = made.mapped.join(made.pieces.select("amplicon", "seq"), "amplicon").withColumn("cut", F.expr("substring(seq, cast(rel_start AS int), cast(rel_end - rel_start + 1 AS int))"))
    got = {r.name: r for r in both.collect()}
    assert got["a"].cut == SEQS["c1"][32:70] and got["b"].cut == SEQS["c1"][99:101] and (got["a"].group_start, got["a"].label) == ("x", "y")
    assert sorted(r.value for r in amplicons.bed_lines(made.mapped).collect()) == ["a_c1_33_70\t16\t54\ta\t1.5\t-", "b_c1_100_101\t16\t18\tb\t.\t."]
    assert amplicons.summary(made).collect()[0].asDict() == {"parsed_intervals": 2, "written_amplicons": 2, "mean_amplicon_length": ((38 + 32) + (2 + 32)) / 2}


def test_nothing_to_amplify(spark):
    made = amplicons.build(spark.createDataFrame([], "chrom string, start_ long, end_ long, name string"), chunks(spark), 1, 1, 32)
    assert made.pieces.count() == 0 and amplicons.summary(made).collect()[0].asDict() == {"parsed_intervals": 0, "written_amplicons": 0, "mean_amplicon_length": None}
