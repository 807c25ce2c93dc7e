"""Rule bitmask ledger: each rule is evaluated once; policies and ablations are bit operations on what is stored.

The ledger holds a document's measurements and fail_bits, in which bit i is set where rule i fails. A policy is a
version with a mask of rules that reject. Nothing is read again to apply another policy, and an ablation (what would
dropping a rule keep?) is a sum over the few distinct values of fail_bits.

Null or empty text: no words, all measurements 0, so the base rule fails and kept is false. Repeated rows each get
their own row of results, ties can't occur, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, pieces, table, windows, word_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_stutters")


class Rule(NamedTuple):
    """fails: a condition on measurements. The place in RULES is the bit; new rules go to the end."""

    name: str
    fails: Callable[[], Column]


RULES = (
    Rule("few_words", lambda: F.col("n_words") < 20),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("duplicate_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    Rule("few_letters", lambda: 2 * F.col("n_letters") < F.col("word_chars")),
    Rule("capitals", lambda: 2 * F.col("n_capitals") > F.col("n_letters")),
    Rule("stutters", lambda: 10 * F.col("n_stutters") > 3 * F.col("n_words")),
)
BASE = ("few_words", "repeated_windows")
#: version -> the rules that reject
POLICIES = {"1": BASE, "2": tuple(r.name for r in RULES)}
CURRENT = "2"


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = np.arange(256)
    lead = (code & 0xC0) != 0x80  # one for each code point
    space = np.isin(code, list(b"\x20\x09\x0a\x0b\x0c\x0d"))
    upper = (code >= 65) & (code <= 90)
    letter = upper | ((code >= 97) & (code <= 122)) | (code >= 0xC3)
    by_byte = {"word_chars": lead & ~space, "n_symbols": np.isin(code, list(SYMBOLS)), "n_letters": letter, "n_capitals": upper}
    for batch in pieces(batches, "text"):
        texts = Texts.of(batch.column(1))
        n, found = batch.num_rows, {k: texts.per_doc(v.astype(np.uint8)) for k, v in by_byte.items()}
        words = word_hashes(texts)
        found["n_words"] = np.bincount(words.doc, minlength=n)
        hashes, at = windows(words, WINDOW)
        stutter = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        found["n_stutters"] = np.bincount(words.doc[1:][stutter], minlength=n)
        found["n_repeat_words"] = np.zeros(n, np.int64)
        if len(at):
            own = hashes ^ (words.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            _, place, count = np.unique(own, return_inverse=True, return_counts=True)
            again = at[count[place] > 1]
            step = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(step, again, 1)
            np.add.at(step, again + WINDOW, -1)
            found["n_repeat_words"] = np.bincount(words.doc[np.cumsum(step[:-1]) > 0], minlength=n)
        data, o = texts.data, texts.offsets
        lines = [[x for x in data[o[i] : o[i + 1]].tobytes().split(b"\n") if x.strip()] for i in range(n)]
        found["n_lines"] = np.array([len(x) for x in lines], np.int64)
        found["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], pa.int64()) for k in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits. One pass over the whole texts, no shuffle."""
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(rule.fails(), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES)]
    total = bits[0]
    for x in bits[1:]:
        total = total.bitwiseOR(x)
    return measured.withColumn("fail_bits", total.cast("long"))


def apply_policy(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds policy, base_failed and kept to a ledger; base rules are part of every policy."""
    base = sum(bit(name) for name in BASE)
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return found.withColumns({"policy": F.lit(policy), "base_failed": failed(base), "kept": ~failed(base | mask(policy))})


def ablations(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (rejected by it alone, so kept without it).

    Only the distinct fail_bits with their counts are shuffled: at most 2 to the number of rules."""
    m = mask(policy)
    counts = found.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(bit(x)).cast("long").alias("bit")) for x in POLICIES[policy])))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents")))


_W = r"'[^\x20\x09-\x0D]+'"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_extract_all(text, {_W}) AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_W})) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
f AS (SELECT m.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Za-z\xC0-\x{{10FFFF}}]', '', 'g'))::BIGINT AS n_letters,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_stutters FROM m LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT
  + 64 * (2 * n_letters < word_chars)::INT + 128 * (2 * n_capitals > n_letters)::INT + 256 * (10 * n_stutters > 3 * n_words)::INT)::BIGINT AS fail_bits FROM f)
SELECT *, '2' AS policy, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

QUERIES = {"op1_rule_ledger": op1_rule_ledger}
ORACLES = {"op1_rule_ledger": ORACLE}
