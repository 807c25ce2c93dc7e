"""N-gram Jaccard join by vertical partitioning: exact links between texts whose shingle sets are nearly equal.

Texts are lower-cased in A-Z and cut into words at ASCII white space. A text's set holds the 64-bit hashes of its
distinct SIZE-word shingles (all its words as one if there are fewer; nothing without words). Two sets are linked when
100 * overlap >= LEAST * union. No link between different sets is lost, and no pairs within a group of copies are made:

1. Rows with equal sets fall into one class (a 64-bit hash of the sorted set). Everything below is between classes.
2. The global n-gram order: what is frequent in some part of the corpus comes last, by its count (the HOT most frequent
   n-grams, a table of bounded size), the rest before it, by hash. Any order gives the same links; this one keeps shared
   passages and stock phrases out of the front of each set.
3. Linked sets share an n-gram in the front (1 - LEAST %) of both. Fronts are joined on their n-grams; those that only one
   class has are dropped. A pair must also pass the length bound and a bound on the difference from 512 parity bits, which
   never differ in more places than there are n-grams that only one of the two has; what passes is tested again with 2048
   bits. Where all pairs are compared, both are tested inside the join.
4. First, each n-gram has one hub among its classes, and each class is compared with the best of its hubs; what that leaves in
   different components, with its other hubs. What that links is contracted, and n-grams whose classes are all in one
   component are dropped, so a large group of near copies costs a number of comparisons proportional to its size. Then all pairs in different components are compared whose lengths lie in the same or in
   neighbouring bins; a link's can't lie further apart. A skewed n-gram's rows are split by AQE's skew join.
5. The order is cut into FRAGMENTS, ranges of it. A candidate pair's overlap is counted in each fragment separately, from the fragment's
   n-grams of either class, and summed per pair.
6. Components of the links, on the link table.

Texts of any length are read whole, in batches of PIECE bytes at least one text long. Ties can't occur: all is by sets. Null or
empty text, or no word: n_shingles 0, linked with nothing. Null doc_id: n_shingles is given, component_id is null,
and the row links with nothing. Repeated rows and copies: one class, so one component. Rows of one doc_id with other texts
are classes of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, components, cut, discard, mix64, pieces, stored, table, windows, word_hashes

SIZE = 3
LEAST = 90
HOT = 1 << 18
OFTEN = 2  # times among TOGETHER n-grams, to count as frequent there
TOGETHER = 1 << 20
PIECE = 1 << 19  # bytes of text shingled at a time
FRAGMENTS = 4  # cuts of the order; the last one has the frequent n-grams
_BITS = tuple(f"b{i}" for i in range(8))
_SKETCH = 2048  # parity bits of a set; folded to 512 for the join
_FILTER_BITS = 1 << 23
_CUTS = np.array([(i << 64) // (FRAGMENTS - 1) for i in range(1, FRAGMENTS - 1)], np.uint64)  # the rest of the order is by hash


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): document i's sorted distinct shingles are hashes[bounds[i]:bounds[i + 1]]."""
    words = word_hashes(texts, lower=True)
    docs = len(texts.offsets) - 1
    count = np.bincount(words.doc, minlength=docs)
    token, at = windows(words, size)
    doc = words.doc[at]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(words.doc, few)
        whole = [np.frombuffer(xxhash.xxh3_64_digest(words.hash[a : a + n].tobytes(), seed=int(n)), np.uint64)[0] for a, n in zip(first, count[few], strict=True)]
        token, doc = np.concatenate([token, np.array(whole, np.uint64)]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        token, doc = token[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        token[a:b].sort()
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    return np.concatenate([[0], np.cumsum(new)])[bounds], token[new]


def _class_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(size: int):
    """A row for each document, and rows (token, often) for n-grams that are frequent among those read together."""
    names = ["doc_id", "n", "k", *_BITS, "sketch", "token", "often"]

    def frequent(seen: list[np.ndarray]) -> pa.RecordBatch:
        token = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
        token.sort()
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(token)))
        common, times = token[first[times >= OFTEN]], times[times >= OFTEN]
        none = pa.nulls(len(common), pa.int64())
        return pa.RecordBatch.from_arrays([none] * (3 + len(_BITS)) + [pa.nulls(len(common), pa.list_(pa.int64())), _long(common), pa.array(times.astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in pieces(batches, "text", PIECE):
            bounds, token = shingle_sets(Texts.of(batch.column(1)), size)
            n = np.diff(bounds)
            bit = (mix64(token) & np.uint64(_SKETCH - 1)).astype(np.int64)
            keys, parity = [], np.zeros((len(n), _SKETCH // 8), np.uint8)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                keys.append(_class_key(token[a:b]) if b > a else None)
                parity[i] = np.packbits((np.bincount(bit[a:b], minlength=_SKETCH) & 1).astype(np.uint8))
            sketch = parity.view(np.int64)
            bits = np.bitwise_xor.reduce(sketch.reshape(len(n), -1, len(_BITS)), axis=1)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (_SKETCH // 64)), pa.array(sketch.ravel()))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys, pa.int64()), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(len(_BITS))), whole, none, none], names)
            seen, held = [*seen, token], held + len(token)
            if held >= TOGETHER:
                yield frequent(seen)
                seen, held = [], 0
        yield frequent(seen)

    return run


class _Order:
    """The global n-gram order: frequent ones (sorted hashes, ranks by count) after all others."""

    def __init__(self, token: np.ndarray, often: np.ndarray):
        token = token.view(np.uint64)
        rank = np.empty(len(token), np.int64)
        rank[np.lexsort((token, often))] = np.arange(len(token))
        by_token = np.argsort(token)
        self.token, self.rank_of = token[by_token], rank[by_token]

    def rank(self, token: np.ndarray) -> np.ndarray:
        """-1 for n-grams that are not frequent."""
        if not len(self.token):
            return np.full(len(token), -1, np.int64)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        return np.where(self.token[at] == token, self.rank_of[at], -1)


def _front(own: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    rare = own[rank < 0]
    if len(rare) >= n:
        return rare[:n]
    hot = rank >= 0
    return np.concatenate([rare, own[hot][np.argsort(rank[hot], kind="stable")[: n - len(rare)]]])


def _fronts(size: int, least: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            bounds, token = shingle_sets(Texts.of(batch.column(1)), size)
            rank = order.value.rank(token)
            fronts, keys = [], {}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = _class_key(token[a:b])
                if b > a and key not in keys:
                    n = int(b - a)
                    fronts.append(_front(token[a:b], rank[a:b], n - -(-least * n // 100) + 1))
                    keys[key] = len(fronts[-1])
            if fronts:
                found, key = np.concatenate(fronts), np.repeat(np.array(list(keys), np.int64), list(keys.values()))
                hot = order.value.rank(found) >= 0
                yield pa.RecordBatch.from_arrays([_long(found), pa.array(key), pa.array(key, mask=~hot)], ["token", "k", "salt"])

    return run


def _fragments(size: int, order, wanted):
    """(k, fragment, tokens, of_a, of_b) of documents that may be wanted, as the first or the second of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = ids & (_FILTER_BITS - 1)
            of = (wanted.value[:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            chosen = np.flatnonzero(of.any(axis=0))
            batch, of = batch.take(pa.array(chosen)), of[:, chosen]
            if not batch.num_rows:
                continue
            bounds, token = shingle_sets(Texts.of(batch.column(1)), size)
            fragment = np.where(order.value.rank(token) >= 0, FRAGMENTS - 1, np.searchsorted(_CUTS, token, side="right")).astype(np.int64)
            out: list[tuple[int, int, np.ndarray, bool, bool]] = []
            for a, b, of_a, of_b in zip(bounds[:-1], bounds[1:], *of, strict=True):
                own, part = token[a:b], fragment[a:b]
                out += [(_class_key(own), f, own[part == f], of_a, of_b) for f in range(FRAGMENTS if b > a else 0)]
            out = [x for x in out if len(x[2])]
            if out:
                offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), _long(np.concatenate([x[2] for x in out])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), tokens, *(pa.array([x[i] for x in out], pa.bool_()) for i in (3, 4))], ["k", "fragment", "tokens", "of_a", "of_b"])

    return run


def _may_link(least: int) -> Column:
    """The length bound, and the parity bits' bound, of classes a and b; exact: true wherever a and b are linked."""
    low, high = F.least("n", "n_b"), F.greatest("n", "n_b")
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_b"))) for x in _BITS), F.lit(0))
    # overlap >= least / (100 + least) * (n + n_b), so the difference n + n_b - 2 * overlap is at most (100 - least) / (100 + least) of n + n_b
    return (low * 100 >= high * least) & (differ * (100 + least) <= (F.col("n") + F.col("n_b")) * (100 - least))


def _frequent(described: DataFrame) -> _Order:
    """The order with the most frequent n-grams, at most HOT of them, last."""
    counted = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("often").alias("often"))
    # the least count with at most HOT n-grams at or above it, from the few distinct counts
    room, least = HOT, None
    for r in counted.groupBy(F.least("often", F.lit(1 << 16)).alias("often")).agg(F.count("*").alias("n")).orderBy(F.desc("often")).collect():
        if r.n > room:
            break
        room, least = room - r.n, r.often
    if least is None:
        return _Order(np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot = counted.filter(F.col("often") >= least).toArrow()
    return _Order(*(hot.column(c).to_numpy().astype(np.int64) for c in ("token", "often")))


def _differ_little(classes: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """pairs (a, doc, n, b, doc_b, n_b) without those whose whole sketches differ in more bits than linked sets can.

    classes has one row for each k, so copies don't multiply the pairs."""
    x, y = (classes.select(F.col("k").alias(k), F.col("sketch").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, z: s + z)
    near = differ * (100 + least) <= (F.col("n") + F.col("n_b")) * (100 - least)
    return pairs.join(x, "a").join(y, "b").filter(near).select(*pairs.columns).distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, order, size: int, least: int) -> DataFrame:
    """The linked ones of candidate pairs (a, doc, n, b, doc_b, n_b): overlaps counted by fragment, then summed."""
    spark = docs.sparkSession
    pairs = cut(_differ_little(classes, pairs, least))
    bit = F.col("doc").bitwiseAND(F.lit(_FILTER_BITS - 1))
    side = lambda doc, second: pairs.select(F.col(doc).alias("doc"), F.lit(second).alias("second"))
    mask = lambda which: F.expr(f"bit_or(if({which}, shiftleft(1L, cast(doc & 63 AS int)), 0L))")
    involved = side("doc", False).unionByName(side("doc_b", True)).groupBy(F.shiftright(bit, 6).alias("w"))
    words = involved.agg(mask("NOT second").alias("of_a"), mask("second").alias("of_b")).collect()  # at most _FILTER_BITS / 64 rows
    wanted = np.zeros((2, _FILTER_BITS >> 6), np.int64)
    for r in words:
        wanted[:, r.w] = r.of_a, r.of_b
    # shingled once, read twice: the fragments of pairs' first classes, then of their second ones. A class has one row for
    # each fragment, or its copies would multiply its pairs; it is written as such, for AQE splits joins of plain exchanges only
    schema = "k long, fragment int, tokens array<long>, of_a boolean, of_b boolean"
    found = docs.mapInArrow(_fragments(size, order, spark.sparkContext.broadcast(wanted.view(np.uint64))), schema)
    parts = stored(found.groupBy("k", "fragment").agg(F.first("tokens").alias("tokens"), F.max("of_a").alias("of_a"), F.max("of_b").alias("of_b")))
    each = pairs.select("a", "b", "n", "n_b").join(parts.filter("of_a").select(F.col("k").alias("a"), "fragment", F.col("tokens").alias("x")), "a")
    each = each.join(parts.filter("of_b").select(F.col("k").alias("b"), "fragment", F.col("tokens").alias("y")), ["b", "fragment"])
    overlap = each.groupBy("a", "b", "n", "n_b").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("o"))
    linked = cut(overlap.filter(F.col("o") * 100 >= (F.col("n") + F.col("n_b") - F.col("o")) * least).select("a", "b"))
    discard(parts)
    return linked


def link(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, n, k of every row; and of every linked class k, its component's root."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    longs = ", ".join(f"{c} long" for c in ("doc_id", "n", "k", *_BITS))
    described = stored(docs.mapInArrow(_describe(size), f"{longs}, sketch array<long>, token long, often long"))
    rows = described.filter("n IS NOT NULL")
    order = spark.sparkContext.broadcast(_frequent(described))
    docs = docs.filter("doc_id IS NOT NULL")
    worded = rows.filter("doc_id IS NOT NULL AND k IS NOT NULL")
    classes = stored(worded.groupBy("k").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), *(F.max(x).alias(x) for x in _BITS), F.first("sketch").alias("sketch")))

    # (token, k, salt); n-grams that no other class has go. Frequent ones stay untried, so that none fills a task: their salt is k
    fronts = docs.mapInArrow(_fronts(size, least, order), "token long, k long, salt long")
    group = Window.partitionBy("token", "salt")
    fronts = fronts.withColumns({"lo": F.min("k").over(group), "hi": F.max("k").over(group)}).filter("lo < hi OR salt IS NOT NULL")
    fronts = stored(fronts.dropDuplicates(["token", "salt", "k"]).select("token", "k"))
    # n-grams of the front that no other class has: none in the text that others are near copies of
    own = fronts.groupBy("k").agg(F.count("*").alias("found"))
    alone = (F.col("n") - F.ceil(F.col("n") * least / 100) + 1 - F.col("found")).cast("long")
    known = cut(classes.drop("sketch").join(own, "k").withColumn("alone", alone).drop("found"))
    posted = stored(fronts.join(known.select("k", "alone", F.col("n").cast("int").alias("n")), "k"))
    discard(fronts)

    side = lambda name, end: known.select(F.col("k").alias(name), *(F.col(c).alias(f"{c}{end}") for c in ("doc", "n", *_BITS)))
    may = lambda met: cut(met.join(side("a", ""), "a").join(side("b", "_b"), "b").filter(_may_link(least)).select("a", "doc", "n", "b", "doc_b", "n_b"))
    hubs = posted.groupBy("token").agg(F.min(F.struct("alone", "k", "n")).alias("h")).select("token", "h")
    # hubs of lengths that can't be linked go before pairs are shuffled
    alike = F.least("n", "h.n").cast("long") * 100 >= F.greatest("n", "h.n").cast("long") * least
    met = stored(posted.join(hubs, "token").filter((F.col("k") != F.col("h.k")) & alike).select(F.col("k").alias("a"), F.struct("h.alone", "h.k").alias("h")).distinct())
    # each class with the best of its hubs; what that leaves apart, with its other hubs
    pairs = may(met.groupBy("a").agg(F.min("h").alias("h")).select("a", F.col("h.k").alias("b")))
    links = _verified(docs, classes, pairs, order, size, least)
    roots = cut(components(links))
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    apart = met.select("a", F.col("h.k").alias("b")).join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = may(apart.select("a", "b").join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    discard(met)
    if not more.isEmpty():
        links, pairs = cut(links.unionByName(_verified(docs, classes, more, order, size, least))), pairs.unionByName(more)
        roots = cut(components(links))

    # n-grams whose classes are all in one component by now have nothing left to link
    rooted = posted.drop("alone", "n").join(roots.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    open_ = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    # lengths of linked classes differ by LEAST % at most, so they lie in the same bin of lengths or in neighbours
    length_bin = F.floor(F.log(F.col("n")) / (1.001 * math.log(100 / least)) if least < 100 else F.col("n"))
    left = stored(rooted.join(open_, "token", "left_semi").join(known.drop("alone"), "k").withColumn("bin", length_bin))
    # b is the shorter one (or has the lesser key), so it is in a's bin or the one before
    right = left.select("token", *(F.col(c).alias(f"{c}_b") for c in ("k", "doc", "n", *_BITS, "root")), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    shorter = F.struct("n_b", "k_b") < F.struct("n", "k")
    more = left.join(right, ["token", "bin"]).filter(shorter & (F.col("root") != F.col("root_b")) & _may_link(least)).select(F.col("k").alias("a"), "doc", "n", F.col("k_b").alias("b"), "doc_b", "n_b").distinct()
    swapped = F.struct("n", "a") < F.struct("n_b", "b")
    done = pairs.select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
    more = cut(more.join(done, ["a", "b"], "left_anti"))
    discard(posted, left)
    if not more.isEmpty():
        links = links.unionByName(_verified(docs, classes, more, order, size, least))
        roots = cut(components(links))
    discard(classes)
    return rows.select("doc_id", "n", "k"), roots


def component_keys(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(doc_id, root) of each doc_id with words: the component's key, equal for linked classes and for copies."""
    rows, roots = link(docs, size, least)
    classes = rows.filter("doc_id IS NOT NULL AND k IS NOT NULL").select("doc_id", "k").distinct()
    return classes.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("doc_id", F.coalesce("root", "k").alias("root"))


def join_components(docs: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows, roots = link(docs, size, least)
    classes = rows.filter("doc_id IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))
    rooted = classes.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("own", F.col("root").isNull()).withColumn("root", F.coalesce("root", "k"))
    rooted = rooted.filter("NOT own OR copies > 1")  # of all others, the component is the row itself
    least_doc = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    label = rooted.join(least_doc, "root").select("k", "component_id")
    return rows.join(label, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_join": op4_ngram_join}
