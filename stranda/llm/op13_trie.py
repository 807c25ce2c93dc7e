"""Conversation prefix trie by whole-sequence collapse: identical conversations become one weighted sequence with a list of
its ends, sequences that another continues are dropped by an anti-join (what is left are the leaves), and the prefixes of
the weighted sequences are added up to nodes.

All steps work on rows of turns; no conversation is gathered. A prefix is known by its depth and 128 bits: the exclusive-or of
two 64-bit hashes of each (position, role, text), summed by a running window, so equal prefixes need no comparison of texts.

Null role or text is the empty string, rows of one turn are ordered by role, then text, a null turn comes first. Equal rows are
turns of their own. Rows without conv_id belong to no conversation and are left out. Very long texts are hashed and
counted where they lie. An empty table has no conversations, so no root either. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, stored, table

NODE = ["depth", "z1", "z2"]
BUCKET = 4096  # conversation numbers whose list is one value, before lists are digested in order
FAMILY, HEADS = 100, 6  # the contract's rebuilding: heads of fewer than HEADS turns come from the first of each FAMILY


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, at (place of the turn, from 0), role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return plain.withColumn("at", (F.row_number().over(order) - 1).cast("long")).select("conv_id", "at", "role", "text")


def rebuilt(own: DataFrame) -> DataFrame:
    """The contract's conversations: conv_id, at, role, text as turns(), but for a row at -1 for each conversation, so that
    those without turns are kept. Conversations share the heads of their families."""
    c = F.col("conv_id")
    own = own.withColumn("h", F.crc32(c.cast("string")) % HEADS)
    marks = own.groupBy("conv_id", "h").agg(F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"))
    heads = own.filter((c % FAMILY == 0) & (F.col("at") < HEADS - 1)).select(c.alias("family"), "at", "role", "text")
    lent = marks.select("conv_id", "h", (c - c % FAMILY).alias("family")).join(heads, "family").filter("at < h").select("conv_id", "at", "role", "text")
    return own.filter("at >= h").select("conv_id", "at", "role", "text").unionByName(lent).unionByName(marks.select("conv_id", "at", "role", "text"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, z1, z2 (together the prefix), p1, p2 (the prefix before), chars of the last text, ends (it is all).

    Only the hashes and lengths of texts are shuffled."""
    order = Window.partitionBy("conv_id").orderBy("at")
    slim = rows.select("conv_id", "at", F.length("text").cast("long").alias("chars"), F.xxhash64(F.lit(1), "role", "text").alias("x1"), F.xxhash64(F.lit(2), "text", "role").alias("x2"))
    placed = slim.withColumn("depth", (F.row_number().over(order) - 1).cast("long"))
    mark = lambda k: F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", f"x{k}"))
    z = placed.withColumns({f"z{k}": F.bit_xor(mark(k)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for k in (1, 2)})
    return z.select("conv_id", *NODE, F.lag("z1").over(order).alias("p1"), F.lag("z2").over(order).alias("p2"), "chars", F.lead("z1").over(order).isNull().alias("ends"))


def sequences(found: DataFrame) -> DataFrame:
    """Identical conversations as one: NODE (the whole sequence), weight, first (the least conv_id of them)."""
    return found.filter("ends").groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("first"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows of equal keys, of their lists joined by commas; holds no list beyond its row."""
    key, sha, done = None, hashlib.sha256(), []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], [*NODE, "ends_sha256"])

    for batch in batches:
        for *k, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if done:
            yield rows()
    if key:
        done.append((*key, sha.hexdigest()))
        yield rows()


def end_lists(found: DataFrame) -> DataFrame:
    """NODE, ends_sha256. Lists are joined for ranges of BUCKET numbers first; then each sequence's few ranges pass in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = found.filter("ends").groupBy(*NODE, F.floor(F.col("conv_id") / BUCKET).alias("range")).agg(ids.alias("ids"))
    return ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids").mapInArrow(_digest, "depth long, z1 long, z2 long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node of the conversations' turns (as of rebuilt()): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A node's least conversation is the first of its sequence, so it also names the sequence that counts what the node saves."""
    found = stored(prefixes(rows))
    whole = sequences(found)
    # a sequence's prefixes, once for all its conversations
    each = stored(found.withColumnRenamed("conv_id", "first").join(whole.select("first", "weight"), "first"))
    leaves = each.filter("ends").join(each.filter("NOT ends").select(*NODE), NODE, "left_anti").select("first", F.lit(1).cast("long").alias("leaf"))
    counted = each.join(leaves, "first", "left").groupBy(*NODE).agg(
        F.min("first").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("chars").alias("chars")
    )
    nodes = stored(counted)
    saves = nodes.select(F.col("conv_id").alias("first"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"))
    below = Window.partitionBy("first").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = each.select("first", *NODE).join(saves, ["first", "depth"], "left").withColumn("below", F.sum(F.coalesce("saves", F.lit(0))).over(below))
    saved = saved.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("z1"), F.col("p2").alias("z2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("z1").alias("p1"), F.col("z2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(saved, NODE).join(children, NODE, "left").join(end_lists(found), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


ORACLE = f"""
WITH r AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(t ORDER BY i) AS l, {crc32_sql("conv_id")} % {HEADS} AS h FROM r GROUP BY conv_id),
s AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
m AS (SELECT conv_id, depth, l[1:depth] AS k, len(l) = depth AS ends, coalesce(length(l[depth].text), 0) AS chars FROM (SELECT conv_id, unnest(range(0, len(l) + 1)) AS depth, l FROM s)),
g AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS ends, (count(*) - 1) * max(chars) AS saves
  FROM m GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids USING (depth, k)),
u AS (SELECT unnest(range(0, depth + 1)) AS depth, k, saves, (n_children = 0)::INT AS leaf FROM f),
sub AS (SELECT depth, k[1:depth] AS k, sum(saves) AS saved, sum(leaf) AS leaves FROM u GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves,
  sub.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN sub USING (depth, k) LEFT JOIN f p ON p.depth = f.depth - 1 AND p.k = f.k[1:f.depth - 1]
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": ORACLE}
