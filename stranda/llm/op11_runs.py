"""Periodic runs: one online pass over the words of a text, with a match length for each active lag.

A word that equals the word q places before it lengthens the diagonal of lag q by one; a diagonal that the next word does
not lengthen has ended, and is a run at once if it is long enough. Following all earlier occurrences of a word would take
a number of steps quadratic in its count, so a diagonal is followed only where it can become a run: a run of smallest
period q has 4 periods at least, and in it, a gram of 2 to 4 times a power of two, no shorter than q, last occurred exactly q
words before (the rotations of a period that repeats no shorter one all differ). So each word has one candidate lag for each
power of two, that of the nearest earlier occurrence of the gram that ends there: n log n steps, and no run is missed.
Grams are numbered exactly (a gram's number stands for the pair of numbers of its halves), not hashed.

Null or empty text: no words, no runs, collapsed is empty. Very long texts are taken whole, in memory that grows with the
text. Repeated rows each get their own row; a null doc_id is carried along. An empty table gives an empty result, and
columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, crc32_sql, pieces, table

LEAST, PERIODS = 6, 4  # a run has LEAST words and PERIODS periods at least
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def matches(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, width) in the order of words: the gram of width words that ends at word was last seen lag words before.

    ids are numbers of words, doc the ascending text of each. Lags from low to 2 low - 1 are asked of grams of 2 low words."""
    n, room = len(ids), (np.bincount(doc) // PERIODS)[doc] if len(doc) else doc
    name, low, found = ids, 1, []
    while 2 * low <= n:
        at = np.flatnonzero((name[: n - 2 * low + 1] >= 0) & (name[low : n - low + 1] >= 0) & (doc[: n - 2 * low + 1] == doc[2 * low - 1 :]) & (room[: n - 2 * low + 1] >= low))
        if not len(at):
            break
        pair = name[at] * (n + 1) + name[at + low]
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        new = pair[1:] != pair[:-1]
        again = ~new & (doc[at[1:]] == doc[at[:-1]])
        lag = (at[1:] - at[:-1])[again]
        near = (lag >= low) & (lag < 2 * low)
        found.append((at[1:][again][near] + 2 * low - 1, lag[near], np.full(near.sum(), 2 * low)))
        # only grams that a text has twice can be parts of longer ones that it has twice
        twice = np.append(again, False) | np.append(False, again)
        name = np.full(n, -1, np.int64)
        name[at[twice]] = np.append(0, np.cumsum(new))[twice]
        low *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    word, lag, width = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    return word[order], lag[order], width[order]


def diagonals(word: np.ndarray, lag: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of each run, as its diagonal ends."""
    active: dict[int, tuple[int, int]] = {}  # lag: (length of the match, last word of it)
    for i, q, g in zip(word.tolist(), lag.tolist(), width.tolist()):
        for ended in [p for p, (_, last) in active.items() if last < i - 1]:
            yield from _ended(ended, *active.pop(ended))
        matched, _ = active.get(q, (g - 1, i))
        active[q] = matched + 1, i
    for q, at in active.items():
        yield from _ended(q, *at)


def _ended(q: int, matched: int, last: int) -> Iterator[tuple[int, int, int]]:
    length = matched + q
    if length >= max(LEAST, PERIODS * q):
        yield last - length + 1, length, q


def _find(edit: Callable[[int | None, list[bytes]], list[bytes]] | None) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts, doc_ids = Texts.of(batch.column(1)), batch.column(0).to_pylist()
            words = [texts.data[lo:hi].tobytes().split() for lo, hi in zip(texts.offsets, texts.offsets[1:])]  # bytes split at the contract's white space
            if edit:
                words = [edit(*x) for x in zip(doc_ids, words)]
            sizes = np.array([len(w) for w in words], np.int64)
            starts, number = np.cumsum(sizes) - sizes, {}
            ids = np.fromiter((number.setdefault(w, len(number)) for text in words for w in text), np.int64, sizes.sum())
            doc = np.repeat(np.arange(len(words)), sizes)
            runs: list[list] = [[] for _ in words]
            kept: dict[int, np.ndarray] = {}
            for start, length, period in diagonals(*matches(ids, doc)):
                d = int(doc[start])
                first = start - int(starts[d])
                runs[d].append((first, length, period))
                kept.setdefault(d, np.ones(sizes[d], bool))[first + period : first + length] = False
            collapsed = [b" ".join(w if d not in kept else [w[i] for i in np.flatnonzero(kept[d])]) for d, w in enumerate(words)]
            runs = [[dict(zip(("start", "length", "period"), r)) for r in sorted(found, key=lambda r: (r[0], r[2]))] for found in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed: the words that no run
    repeats, joined by spaces. edit may change a text's words before. One pass over the whole texts, no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find(edit), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetition: of each tenth document by its CRC, the words from a on become periodic."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(better(b, r), r).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


#: Pairs of equal words by lag, islands of them, and of islands in one place the smallest lag.
ORACLE = rf"""
WITH w0 AS (SELECT doc_id, {crc32_sql("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w1 AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, CASE WHEN len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p FROM w0),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM w1),
t AS (SELECT doc_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM w),
m AS (SELECT y.doc_id, y.i - x.i AS q, y.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.x = y.x AND x.i < y.i AND {PERIODS} * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
long AS (SELECT doc_id, q, min(i) - q AS s, count(*) + q AS len FROM island GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({LEAST}, {PERIODS} * q)),
r AS (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.doc_id = l.doc_id AND o.q < l.q AND o.s <= l.s AND o.s + o.len >= l.s + l.len)),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) = 1),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM w LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES = {"op11_periodic_runs": ORACLE}
