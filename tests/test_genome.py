import random

import pytest
from pyspark.sql import functions as F

from stranda.operators import genome, kmers
from stranda.sources import fasta

RNG = random.Random(8)
SEQS = {"c1": "".join(RNG.choice("ACGTacgt") for _ in range(731)), "c2": "", "c3": "A", "c4": "".join(RNG.choice("ACGT") for _ in range(205))}


def body(width):
    out = []
    for name, seq in SEQS.items():
        out += [f">{name} some words"] + [seq[i : i + width] for i in range(0, len(seq), width)]
    return "\n".join(out) + "\n"


@pytest.fixture
def tiny_splits(spark):
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("split", [7, 61, 10_000])
def test_records_survive_any_split(spark, tmp_path, tiny_splits, split):
    (tmp_path / "a.fa").write_text(body(50))
    (tmp_path / "b.fa").write_text(">d1\r\nACGT\r\n>d2\nGG\n\nTT")
    tiny_splits(split)
    got = genome.chunked(fasta.read_fasta(spark, str(tmp_path)), 64).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.chunk):
        whole[r.chrom] = whole.get(r.chrom, "") + r.seq
    assert whole == {k: v for k, v in SEQS.items() if v} | {"d1": "ACGT", "d2": "GGTT"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("genome"))
    segments = spark.createDataFrame([(k, 0, v) for k, v in SEQS.items()] + [("gap", 10, "ACG"), ("gap", 20, "T")], "chrom string, at long, seq string")
    genome.chunked(segments, 64).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_fetch_fills_with_n(spark, stored):
    at = lambda seq, s, e: "".join(seq[p - 1] if 1 <= p <= len(seq) else "N" for p in range(s, e + 1))
    rows = [(i, "c1", s := RNG.randrange(-90, 800), s + RNG.randrange(-1, 300)) for i in range(60)]
    rows += [(100, "c1", -90, -5), (101, "c1", 900, 990), (102, "nowhere", 5, 9), (103, "gap", 1, 30), (104, "c1", 64, 65), (105, "c1", 65, 64), (106, "c1", 1, 731)]
    seqs = SEQS | {"nowhere": "", "gap": "N" * 10 + "ACG" + "N" * 7 + "T"}
    got = {r.id: r.seq for r in genome.fetch(spark.createDataFrame(rows, "id long, chrom string, start_ long, end_ long"), stored, ["id"], 64).collect()}
    assert got == {i: at(seqs[c], s, e) for i, c, s, e in rows}
    part = genome.fetch(spark.createDataFrame([(1, "c4", 995, 1010)], "id long, chrom string, start_ long, end_ long"), stored, ["id"], 64, {"c4": 1000})
    assert part.first().seq == "N" * 5 + SEQS["c4"][:11]


def test_modes(spark, stored):
    exons = spark.createDataFrame([("t", "c4", 10, 20, "-"), ("t", "c4", 60, 70, "-"), ("u", "c4", 60, 70, "+"), ("u", "c4", 10, 20, "+")], "tx string, chrom string, start_ long, end_ long, strand string")
    s = SEQS["c4"]
    joined = s[9:20] + "*" + s[59:70]
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    get = lambda **k: {r.tx: r.seq for r in genome.sequences(exons, stored, ["tx"], size=64, **k).collect()}
    assert get(mode="spliced", boundaries=True) == {"t": turn(joined), "u": joined}
    assert get(mode="translated") == {"t": turn(joined.replace("*", "")), "u": joined.replace("*", "")}
    one = exons.filter("start_ = 10")
    assert {r.tx: r.seq for r in genome.sequences(one, stored, ["tx"], "rna", 64).collect()} == {"t": turn(s[9:20]), "u": s[9:20]}


def windowed(text, n, step):
    """Windows of a text as (offset, letters): each full one, then a cut one if it begins inside and adds something."""
    out, at = [], 0
    while at + n <= len(text):
        out.append((at, text[at : at + n]))
        at += step
    covered = out[-1][0] + n if out else 0
    if at < len(text) and covered < len(text):
        out.append((at, (text[at:] + "N" * n)[:n]))
    return out


@pytest.mark.parametrize("width,step,padding", [(1, 1, False), (5, 2, True), (7, 20, False), (64, 64, False), (3, 50, True)])
def test_windows_equal_those_of_the_whole_text(spark, stored, width, step, padding):
    for region in (None, ("c1", 3, 6), ("c1", 60, 200), ("c1", 700, 9999), ("c4", -5, 64)):
        want = []
        for c, seq in SEQS.items():
            if region and c != region[0]:
                continue
            lo, hi = (max(1, region[1]), min(region[2], len(seq))) if region else (1, len(seq))
            if not seq:
                continue
            pad = "N" * (width // 2) if padding else ""
            want += [(c, lo - len(pad) + o, lo - len(pad) + o + width - 1, w) for o, w in windowed(pad + seq[lo - 1 : hi] + pad, width, step)]
        got = genome.windows(stored.filter("chrom LIKE 'c%'"), width, step, padding, region, 64)
        assert sorted(map(tuple, got.collect())) == sorted(want), region


def test_windows_of_known_regions(spark):
    df = genome.chunked(spark.createDataFrame([("chr7", 0, "TTGTGCCATT")], "chrom string, at long, seq string"), 8)
    get = lambda **k: sorted((r.start_, r.end_, r.seq) for r in genome.windows(df, 5, 3, region=("chr7", 3, 6), size=8, **k).collect())
    assert get() == [(3, 7, "GTGCN")] and get(padding=True) == [(1, 5, "NNGTG"), (4, 8, "TGCNN")]


def test_a_region_of_stored_chunks_is_pushed_down(spark, stored):
    plan = genome.windows(stored, 5, 5, region=("c1", 100, 120), size=64)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(chunk,1)" in plan


def brute_positions(seqs, kmers, both, overlapping):
    out = []
    for chrom, seq in seqs.items():
        for kmer in kmers:
            turned = kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))
            for strand, x in [("+", kmer)] + ([("-", turned)] if both and turned != kmer else []):
                at = seq.upper().find(x)
                while at >= 0:
                    out.append((chrom, kmer, strand, at + 1))
                    at = seq.upper().find(x, at + (1 if overlapping else len(x)))
    return sorted(out)


@pytest.mark.parametrize("both,overlapping", [(False, False), (True, False), (True, True)])
def test_kmers_equal_brute_force(spark, both, overlapping):
    rng = random.Random(4)
    seqs = {"a": "".join(rng.choice("ACGT") for _ in range(900)), "b": "A" * 333 + "C" + "AC" * 150, "c": "ac" * 9, "d": "G"}
    table = genome.chunked(spark.createDataFrame([(k, 0, v) for k, v in seqs.items()], "chrom string, at long, seq string"), 32)
    searched = ["ACA", "AA", "AAAAA", "ACACACA", "CG", "G", "ACGTACGTACGTACGTACGTACGTACGTACGT", seqs["a"][100:125]]
    df = spark.createDataFrame([(k,) for k in searched + ["", "aa"]], "kmer string")
    got = sorted(map(tuple, kmers.find_positions(table, df, both, overlapping, 32).collect()))
    assert got == brute_positions(seqs, searched, both, overlapping)


def test_targets_count_genes(spark):
    tx = spark.createDataFrame([("t1", "g1", "AACCGG"), ("t2", "g1", "TTAACC"), ("t3", "g2", "AACCAACC"), ("t4", "g3", "A")], "tx_id string, gene_id string, seq string")
    df = spark.createDataFrame([("AACC",), ("CCGG",), ("GGGGG",)], "kmer string")
    got = sorted(map(tuple, kmers.targets(df, tx).select("kmer", "tx_id", "n_genes").collect()))
    assert got == [("AACC", "t1", 2), ("AACC", "t2", 2), ("AACC", "t3", 2), ("CCGG", "t1", 1)]


def test_spliced_rows_of_any_place(spark, stored):
    at = lambda c, s, e: "".join(seq[p - 1] if 1 <= p <= len(seq := SEQS.get(c, "")) else "N" for p in range(s, e + 1))
    parts = {"a": [("c4", -5, 3), ("c4", 60, 200), ("c4", 201, 200)], "b": [("c4", -9, -2), ("c4", 190, 300)], "c": [("nowhere", 2, 70)], "d": [("c3", 1, 1)]}
    rows = [(tx, g, *p, "+") for tx, ps in parts.items() for p in ps for g in (tx + "1", tx + "2", None)]  # each row three times
    exons = spark.createDataFrame(rows, "tx string, gene string, chrom string, start_ long, end_ long, strand string")
    for mark in ("", "*"):
        got = genome.sequences(exons, stored, ["tx"], "spliced", 64, bool(mark), kept=("gene",)).collect()
        assert {r.tx: r.seq for r in got} == {tx: mark.join(at(*p) for p in ps) for tx, ps in parts.items()}
    assert {r.tx: set(r.gene) for r in got} == {tx: {tx + "1", tx + "2", None} for tx in parts}


def brute_targets(tx, searched, both):
    hits = set()
    for t, g, seq in tx:
        for kmer in {x.upper() for x in searched if x}:
            turned = "".join({"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}.get(c, "*") for c in reversed(kmer))
            if kmer in (seq or "").upper() or both and turned in (seq or "").upper():
                hits.add((kmer, t, g))
    return sorted(((k, t, g, len({h[2] for h in hits if h[0] == k and h[2]})) for k, t, g in hits), key=str)


@pytest.mark.parametrize("both,most,longest", [(False, 99, 99), (True, 99, 99), (False, 3, 99), (True, 99, 39)])
def test_targets_equal_brute_force(spark, monkeypatch, both, most, longest):
    monkeypatch.setattr(kmers, "MOST", most)
    monkeypatch.setattr(kmers, "LONGEST", longest)
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    tx = [(i, rng.choice(["g1", "g2", "g3", "g4", None]), make(rng.randrange(0, 90))) for i in range(60)]
    tx += [(1, "g9", "acgtNacgt*" + make(30)), (1, "g9", make(40)), (70, "g1", None), (71, "g5", ""), (72, "g6", "äC中GTA"), (73, "g7", "CC" + tx[5][2])]
    searched = ["A", "CG", "ACG", "acgtn", "GT*A", "中GT", "XAC", "GT*", "", tx[5][2][:40], tx[5][2][1:40], make(50)] + [make(rng.randrange(3, 7)) for _ in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # genes go on in the next batch
    try:
        got = kmers.targets(spark.createDataFrame([(k,) for k in searched], "kmer string"), spark.createDataFrame(tx, "tx_id long, gene_id string, seq string"), both)
        assert sorted(map(tuple, got.select("kmer", "tx_id", "gene_id", "n_genes").collect()), key=str) == brute_targets(tx, searched, both)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_targets_of_no_kmers(spark):
    tx = spark.createDataFrame([("t1", "g1", "AACCGG")], "tx_id string, gene_id string, seq string")
    assert kmers.targets(spark.createDataFrame([("",)], "kmer string"), tx).collect() == []


def test_targets_dont_shuffle_words(spark):
    tx = spark.createDataFrame([("t1", "g1", "AACCGG")], "tx_id string, gene_id string, seq string")
    plan = kmers.targets(spark.createDataFrame([("AACC",)], "kmer string"), tx)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lookup_in_runs_of_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kmers, "LETTERS", 50)
    rng = random.Random(7)
    rows = [["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 20, 130]))) for _ in range(rng.choice([0, 1, 1, 2]))] for _ in range(80)]
    rows += [[], ["AC", "GA"]]  # as many sequences as rows, and no ACG
    searched = ["ACG", "TT", "ACGTACGTACGTACG", "ACGTACGTACGTACGTACGT", rows[0][0][:12] if rows[0] else "GGG", max((s for r in rows for s in r), key=len)[5:40]]
    look = kmers._Lookup(list(enumerate(searched)))
    got = set()
    for chunk in (pa.array(rows, pa.list_(pa.string())), pa.array([["ACG"]] + rows, pa.list_(pa.string())).slice(1)):
        found = set()
        for a, b, pairs in look.read(chunk):
            row, kmer = look.split(pairs)
            found |= {(int(r) + a, int(k)) for r, k in zip(row, kmer)}
        assert found == {(i, k) for i, r in enumerate(rows) for k, x in enumerate(searched) if any(x in s for s in r)}
        got |= found
    assert got
