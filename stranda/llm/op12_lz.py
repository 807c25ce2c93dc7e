"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against the indexed blocks of all documents.

Blocks are cut by content: each window of WINDOW words chooses the least hash among its grams of SEED words (the anchor),
and windows that choose the same one make a block, so a passage of WINDOW words is cut alike wherever it stands. Each
distinct block is indexed under its anchor with its least doc_id; a document's blocks are looked up by joins on anchors, so a
document meets all reference blocks that can share a window with it, and no others.

Parsing is greedy, from the left: a factor goes on as long as the next block is whole in the index with a lesser doc_id. Where
it ends, the block shares its anchor with others but is not one of them: its windows, at most WINDOW - SEED + 1, are checked
one by one against the least doc_id of the same windows of the anchor's other blocks. Factors and windows found are the spans.
A block or window is known by 128 bits, two hashes of its words.

Only anchors are shuffled, a few in a hundred words; of copies of a block, one is expanded into windows; no pairs of blocks or
documents are made. Texts are shuffled once, to meet their blocks.

Null or empty texts have no words, nothing is removed from them. Rows without doc_id come after all others: theirs is removed
if any doc_id has it, and they remove nothing from each other. Repeated rows, and rows of one doc_id with other texts, are not before one another;
each gets its row. Very long texts are taken whole, in memory that grows with the text. An empty table gives an
empty result, and columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, mix64, pieces, stored, table, word_hashes

WINDOW, SEED = 50, 12
LAST = 2**63 - 1  # stands for no doc_id
_BASE = 0xD6E8FEB86659FD93
ROW = ["doc", "text_key"]
_WINDOW = "doc long, text_key long, anchor long, place int, content long, start int"
_BLOCK = "anchor long, content long, doc long, text_key long, start int, windows int, place int"


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of h[i : i + width] for each i, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, part, size = np.zeros(n, np.uint64), 0, h, 1
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    while size <= width:
        if width & size:
            total += part[done : done + n] * power(done)
            done += size
        if 2 * size <= width:
            part = part[:-size] + part[size:] * power(size)
        size *= 2
    return mix64(total)


def leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """For each i, the first place of the least value of h[i : i + span]."""
    at, least, size = np.arange(len(h)), h, 1
    while size < span:
        step = min(size, span - size)
        right = least[step:] < least[:-step]
        at, least = np.where(right, at[step:], at[:-step]), np.minimum(least[step:], least[:-step])
        size += step
    return at


def _starts(doc: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(rows + 1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words = word_hashes(Texts.of(batch.column(2)))
        if len(words.hash) < WINDOW:
            continue
        seeds, whole = grams(words.hash, SEED), grams(words.hash, WINDOW)
        anchor = leftmost_least(seeds, WINDOW - SEED + 1)
        at = np.flatnonzero(words.doc[: len(whole)] == words.doc[WINDOW - 1 :])
        if not len(at):
            continue
        edge = np.append(True, (anchor[at[1:]] != anchor[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]]))
        first = at[edge]
        last = at[np.append(np.flatnonzero(edge)[1:] - 1, len(at) - 1)]
        place = anchor[first] - first
        content = mix64(whole[first] + np.uint64(_BASE) * whole[last] + ((last - first) * WINDOW + place).astype(np.uint64))
        doc = words.doc[first]
        yield pa.RecordBatch.from_arrays([
            pa.array(seeds[anchor[first]].view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)),
            pa.array((first - _starts(words.doc, batch.num_rows)[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(place.astype(np.int32)),
        ], [x.split()[0] for x in _BLOCK.split(", ")])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of blocks that are to be checked."""
    for batch in pieces(batches, "text"):
        words = word_hashes(Texts.of(batch.column(2)))
        whole, begin = grams(words.hash, WINDOW), _starts(words.doc, batch.num_rows)
        blocks = batch.column(3)
        row = np.repeat(np.arange(batch.num_rows), np.diff(blocks.offsets.to_numpy()))
        anchor, start, windows, place = (blocks.flatten().field(k).to_numpy() for k in ("anchor", "start", "windows", "place"))
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        row, at = np.repeat(row, windows), np.repeat(start, windows) + step
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.repeat(anchor, windows)), pa.array((np.repeat(place, windows) - step).astype(np.int32)),
            pa.array(whole[begin[row] + at].view(np.int64)), pa.array(at.astype(np.int32)),
        ], [x.split()[0] for x in _WINDOW.split(", ")])


def parse(blocks: list[tuple[int, int]], windows: list[int]) -> list[tuple[int, int]]:
    """The spans of words that are covered: factors grow over blocks (start, end) of the index from left to right, and end at a
    gap; windows that were found at boundaries join them."""
    spans: list[list[int]] = []
    for start, end in sorted(blocks + [(s, s + WINDOW) for s in windows]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def _remove(digest: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts, found = Texts.of(batch.column(2)), []
            for i, (doc, blocks, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)))):
                words = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().split()  # bytes split at the contract's white space
                spans = parse([(b["start"], b["start"] + b["windows"] - 1 + WINDOW) for b in blocks or []], windows or [])
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept = b" ".join(kept + words[at:])
                found.append((None if doc == LAST else doc, len(words), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            types = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()
            columns = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return remove


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join with an aggregate by the same keys. Dealt by a hash of them too, so that the aggregate passes a shuffle of its own
    and the rows of a hot key on the left can be split over tasks."""
    deal = F.xxhash64(*keys)
    return left.withColumn("deal", deal).join(right.withColumn("deal", deal), ["deal", *keys]).drop("deal")


def _found(texts: DataFrame) -> DataFrame:
    """For each row with a block that others share: whole (blocks of a lesser doc_id) and ask (blocks whose windows are to be checked)."""
    blocks = texts.mapInArrow(_blocks, _BLOCK)
    shared = blocks.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    blocks = stored(_spread_join(blocks, shared, ["anchor"]))
    index = blocks.groupBy("anchor", "content").agg(F.min("doc").alias("least"))
    # an anchor with one block has nothing more to check, nor has one whose blocks are all of one document
    mixed = index.groupBy("anchor").agg((F.min("least") < F.max("least")).alias("mixed"))
    index = _spread_join(index, mixed, ["anchor"])
    kind = F.struct("anchor", "start", "windows", "place")
    looked_up = blocks.join(index, ["anchor", "content"]).filter("doc > least OR mixed").groupBy(*ROW)
    pick = lambda when: F.collect_set(F.when(F.expr(when), kind))
    return stored(looked_up.agg(pick("doc > least").alias("whole"), pick("doc = least").alias("ask")))


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of start, end, in words) and kept: the words left, joined by spaces, or with
    digest their SHA-256, so that no text goes on."""
    text = F.col("text").cast("string")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = _found(texts)
    # the three uses of the texts share one shuffle
    asked = texts.join(found.filter("size(ask) > 0").select(*ROW, "ask"), ROW).select(*ROW, "text", "ask").mapInArrow(_windows, _WINDOW)
    least = asked.groupBy("anchor", "place", "content").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    windows = _spread_join(asked, least, ["anchor", "place", "content"]).filter("doc > least").groupBy(*ROW).agg(F.collect_set("start").alias("windows"))
    joined = texts.join(found.select(*ROW, "whole"), ROW, "left").join(windows, ROW, "left").select(*ROW, "text", "whole", "windows")
    return joined.mapInArrow(_remove(digest), "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")


def op12_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM hit),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op12_relative_lz": op12_relative_lz}
ORACLES = {"op12_relative_lz": ORACLE}
