"""K-d tree partitioning: split at distributed weighted medians along the widest metadata dimension until leaves are small.

A row weighs the UTF-8 bytes of its text plus 1. Each node of the tree is split in two of equal weight: along the dimension
of DIMENSIONS in which it is widest (the range of its rows' coordinates, each from 0 to RANGE), rows are ordered by that
coordinate, then a hash of the text, then doc_id, and cut at the weighted median. Splitting ends when leaves reach the target
bytes, that is total / shards. So the law is `bytes`: shards differ by a few rows' weight. Equal texts are neighbours in the
order; where a group of copies lies across a cut and weighs at most GROUP of a leaf, the cut moves to the group's nearer end,
so that small groups stay whole, while large ones are split, as equal sizes demand.

Medians are exact and found without a sort: all nodes of a level are searched at once, by sums over at most BINS ranges of
keys for each node, which are narrowed to the range that holds the median and summed again. The driver only sees these sums,
shards / 2 * BINS rows at most, and the cuts, which become literals of the expression that assigns rows to leaves. Rows are a
narrow table (doc_id, size, coordinates, hash), written once.

Slots are counted in BUCKETS hashed parts of each shard, each numbered by itself after the sizes of the parts before it, so
no shard is sorted as a whole.

Null text: size 1, crc32 0. Null doc_id: sorts first. Null lang or source: coordinate 0. Repeated rows: each gets a slot of its
own; equal rows can't be told apart, so a cut doesn't pass between them. An empty table gives no rows; other columns are
ignored. `shards` must be a power of two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, table

SHARDS = 16
BINS = 2048
RANGE = 1 << 10
GROUP = 0.02
ROWS_IN_BUCKET = 200_000
KEYS = ("c", "t", "d")  # coordinate, text hash, doc_id


def _hashed(c: str) -> Column:
    return F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(RANGE - 1))).cast("long")


#: metadata dimension -> coordinate; text length counts by its logarithm
DIMENSIONS = {
    "lang": lambda: _hashed("lang"),
    "source": lambda: _hashed("source"),
    "length": lambda: F.least(F.lit(RANGE), F.floor(F.log2(F.col("size")) * 32)).cast("long"),
}


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has("lang"), has("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("t"))
    return df.select("doc_id", "size", "text_crc32", "t", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), *(f().alias(f"x_{k}") for k, f in DIMENSIONS.items()))


def _ranges(df: DataFrame) -> dict[int, tuple[str, int]]:
    """node -> (widest dimension, weight)."""
    wide = [(F.max(f"x_{k}") - F.min(f"x_{k}")).alias(k) for k in DIMENSIONS]
    rows = df.groupBy("node").agg(F.sum("size").alias("w"), *wide).collect()
    return {r.node: (max(DIMENSIONS, key=lambda k: (r[k], k)), r.w) for r in rows}


def _coordinate(dimension: dict[int, str]) -> Column:
    return reduce(lambda c, k: F.when(F.col("node").isin([n for n, d in dimension.items() if d == k]), F.col(f"x_{k}")).otherwise(c), DIMENSIONS, F.lit(0).cast("long"))


def _after(cuts: dict[int, tuple[int, int, int]]) -> Column:
    """Whether a row lies after its node's cut (the last key on the left side)."""
    out = F.lit(False)
    for n, (x, t, d) in cuts.items():
        beyond = (F.col("c") > x) | ((F.col("c") == x) & ((F.col("t") > t) | ((F.col("t") == t) & (F.col("d") > d))))
        out = F.when(F.col("node") == n, beyond).otherwise(out)
    return out


def _medians(keyed: DataFrame, weight: dict[int, int], leaf: float) -> dict[int, tuple[int, int, int]]:
    """The last key (coordinate, hash, doc_id) of each node's lighter-or-equal left half."""
    # per node: the place in KEYS, keys fixed before it, the range of this key, the weight before the range
    open_ = {n: [0, (), 0, RANGE, 0] for n in weight}
    cuts: dict[int, tuple[int, int, int]] = {}
    while open_:
        bins = F.lit(None).cast("long")
        for n, (k, fixed, lo, hi, _) in open_.items():
            width = (hi - lo) // BINS + 1
            inside = reduce(lambda a, b: a & b, [F.col(KEYS[i]) == v for i, v in enumerate(fixed)], F.col(KEYS[k]).between(lo, hi))
            # wide ranges of doc_id pass 2**63, so the difference is taken in decimals
            at = F.floor((F.col(KEYS[k]).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long") if hi - lo >= 2**62 else F.floor((F.col(KEYS[k]) - F.lit(lo)) / F.lit(width)).cast("long") if width > 1 else F.col(KEYS[k]) - F.lit(lo)
            bins = F.when((F.col("node") == n) & inside, at).otherwise(bins)
        value = reduce(lambda a, n: F.when(F.col("node") == n, F.col(KEYS[open_[n][0]])).otherwise(a), open_, F.lit(None).cast("long"))
        found = keyed.select("node", bins.alias("bin"), value.alias("v"), "size").filter("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by_node: dict[int, list] = {}
        for r in found:
            by_node.setdefault(r.node, []).append(r)
        for n in list(open_):
            k, fixed, _, _, before = open_[n]
            for r in sorted(by_node[n], key=lambda r: r.bin):
                if 2 * (before + r.w) >= weight[n] or r is max(by_node[n], key=lambda r: r.bin):
                    break
                before += r.w
            if r.lo < r.hi:
                open_[n] = [k, fixed, r.lo, r.hi, before]
                continue
            ends = (*fixed, r.lo)
            if k == 2 or (k == 1 and r.w <= GROUP * leaf):
                # one key is left, or a small group of equal texts: the cut goes to its nearer end
                left = 2 * before + r.w < weight[n]
                cuts[n] = (*ends[:2], ends[2] if k == 2 else 2**63 - 1) if left else _just_before(ends)
                del open_[n]
            else:
                open_[n] = [k + 1, ends, *((0, 2**62) if k == 0 else (-(2**63), 2**63 - 1)), before]
    return cuts


def _just_before(ends: tuple[int, ...]) -> tuple[int, int, int]:
    c, t, *d = ends
    if d and d[0] > -(2**63):
        return c, t, d[0] - 1
    return c, t - 1, 2**63 - 1  # hashes are at least 0, so -1 stands before all of them


def partition(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    df = stored(_narrow(docs))
    total, rows = df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    df, leaves = df.withColumn("node", F.lit(0)), 1
    while leaves < shards:
        ranges = _ranges(df)
        df = cut(df.withColumn("c", _coordinate({n: d for n, (d, _) in ranges.items()})))
        cuts = _medians(df.select("node", *KEYS, "size"), {n: w for n, (_, w) in ranges.items()}, total / shards)
        df, leaves = df.withColumn("node", F.col("node") * 2 + _after(cuts).cast("int")).drop("c"), leaves * 2
    buckets = max(64, -(-rows // (shards * ROWS_IN_BUCKET)))
    placed = df.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.pmod(F.xxhash64("d", "t"), F.lit(buckets)).alias("bucket"))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("i", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("i") - 1).alias("slot"))


def op2_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = partition(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_kdtree": op2_kdtree}
