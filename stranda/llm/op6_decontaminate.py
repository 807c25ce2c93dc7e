"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the training words.

A-Z are lower-cased; words are maximal runs of characters other than ASCII ones that are no digit or letter. An item's
windows are its runs of WINDOW consecutive words, or all its words if it has fewer (none: no window). The hash set holds
a hash of the first LEAD words and one of all words of each window. A document is scanned in one pass: at each word, the
first set, then the second; places that pass are verified by comparing the words themselves, in a join on them. All of it
stays in the row until then, so only documents with hits are ever shuffled.

The set is sent to the executors with the plan while it has at most IN_SET windows of 400 characters on average; a larger
benchmark is joined on the hashes instead, by whatever join Spark picks for its size. Both ways give the same rows.

Null or empty text: no words, no hits. Null doc_id: scanned as any other row. Repeated rows: a row of results each; rows
that share a doc_id are kept apart. Repeated items count by item_id, once each; a null item_id counts as "".
An empty benchmark hits nothing; empty documents give no rows; other columns are kept by `clean` and ignored by `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 10
LEAD = 3
IN_SET = 100_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # before lower-casing, as _WORD
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; lower() does so where all is ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _LOWER.upper(), _LOWER))


def words(text: Column) -> Column:
    """The words of the contract, as an array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP), lambda w: w != "")


def _hash_at(n: int, array: str = "w", i: str = "i") -> str:
    """SQL for the hash of the n words of array from place i (from 1) on."""
    return f"xxhash64(1, {', '.join(f'get({array}, {i} + {k - 1})' for k in range(n))})"


def _lead(n: int) -> int:
    return min(n, LEAD)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """n, gram (the words, joined by spaces), lead and full (hashes), items (their ids as strings, sorted); one row per window."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    each = w.withColumn("n", F.least(F.size("w"), F.lit(size))).select("item", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("g"))
    by_n = lambda f: F.expr(f"CASE n {' '.join(f'WHEN {n} THEN ' + _hash_at(f(n), 'g', '1') for n in range(1, size + 1))} END")
    hashed = each.select("item", "n", F.array_join("g", " ").alias("gram"), by_n(_lead).alias("lead"), by_n(lambda n: n).alias("full"))
    return hashed.groupBy("n", "gram", "lead", "full").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _set(values: set[int]) -> str:
    return ", ".join(f"{v}L" if v != -(2**63) else "-9223372036854775807L - 1" for v in sorted(values))


def _places(lengths: dict[int, tuple[set[int], set[int]]]) -> Column:
    """Array of (i, n, gram) where the words of the row's array w pass both hash sets, by window length."""
    found = []
    for n, (lead, full) in sorted(lengths.items()):
        test = f"{_hash_at(_lead(n))} IN ({_set(lead)}) AND {_hash_at(n)} IN ({_set(full)})"
        at = f"CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n - 1}) ELSE array() END"
        found.append(f"transform(filter({at}, i -> {test}), i -> named_struct('i', i, 'n', {n}, 'gram', array_join(slice(w, i, {n}), ' ')))")
    return F.expr(f"concat({', '.join(found)})" if found else f"cast(array() AS {_PLACES})")


_PLACES = "array<struct<i: int, n: int, gram: string>>"
_SPANS = "array<struct<start: int, end: int>>"


def _placed_by_join(row: DataFrame, windows: DataFrame) -> DataFrame:
    """The same places for a benchmark too large for a plan: the hash at each place is joined with the windows' hashes."""
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # at most WINDOW numbers
    at = F.expr(f"concat({', '.join(f'CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> named_struct({chr(39)}i{chr(39)}, i, {chr(39)}n{chr(39)}, {n}, {chr(39)}full{chr(39)}, {_hash_at(n)})) ELSE array() END' for n in sorted(lengths))})")
    each = row.select("doc_id", "text_hash", F.explode(at).alias("p")).select("doc_id", "text_hash", "p.*")
    hits = each.join(windows.select("n", "full").distinct(), ["n", "full"], "left_semi").distinct()
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("i", "n")).alias("hits"))
    back = row.join(hits, row["doc_id"].eqNullSafe(F.col("d")) & (row["text_hash"] == F.col("h")), "left")
    gram = "named_struct('i', p.i, 'n', p.n, 'gram', array_join(slice(w, p.i, p.n), ' '))"
    return back.withColumn("places", F.expr(f"CASE WHEN hits IS NULL THEN cast(array() AS {_PLACES}) ELSE transform(hits, p -> {gram}) END"))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, in_set: int = IN_SET) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (strings, sorted), spans (of hit words, from 1, end
    exclusive), contaminated, and text_hash, by which rows of one doc_id can be told apart."""
    windows = cut(item_windows(benchmark, size))
    row = docs.select(F.col("doc_id").cast("long"), words(F.col("text")).alias("w")).withColumns({"n_words": F.size("w").cast("long"), "text_hash": F.xxhash64("w")})
    many, chars = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()
    small = not many or (many <= in_set and chars <= 400 * in_set)
    if small:
        lengths: dict[int, tuple[set[int], set[int]]] = {}
        for n, lead, full in windows.select("n", "lead", "full").collect():  # at most in_set rows
            a, b = lengths.setdefault(n, (set(), set()))
            a.add(lead)
            b.add(full)
        placed = row.withColumn("places", _places(lengths))
    else:
        placed = _placed_by_join(row, windows)
    placed = cut(placed.select("doc_id", "text_hash", "n_words", "places"))
    clear = F.size("places") == 0
    each = placed.filter(~clear).select("doc_id", "text_hash", F.explode("places").alias("p")).select("doc_id", "text_hash", "p.*").distinct()
    known = windows.select("n", "gram", "items")
    verified = each.join(F.broadcast(known) if small else known, ["n", "gram"])
    found = verified.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(i, i + n - 1)"))))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"),
    )
    ends = "filter(at, (p, k) -> k = size(at) - 1 OR get(at, k + 1) <> p + 1)"
    starts = "filter(at, (p, k) -> k = 0 OR get(at, k - 1) <> p - 1)"
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "item_ids", F.size("at").cast("long").alias("n_hit"), F.expr(f"zip_with({starts}, {ends}, (a, b) -> named_struct('start', a, 'end', b + 1))").alias("spans"))
    left = placed.filter(~clear)
    hit = left.join(found, left["doc_id"].eqNullSafe(F.col("d")) & (left["text_hash"] == F.col("h")), "left")
    none = {"item_ids": F.expr("cast(array() AS array<string>)"), "n_hit": F.lit(0).cast("long"), "spans": F.expr(f"cast(array() AS {_SPANS})")}
    out = ["doc_id", "n_words", "n_hit", "item_ids", "spans", "text_hash"]
    rows = hit.withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()}).select(*out).unionByName(placed.filter(clear).withColumns(none).select(*out))
    return rows.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": F.col("n_hit") > 0})


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW) -> DataFrame:
    """docs, all columns kept, without contaminated documents, or (remove="spans") with hit words and the gaps before them cut."""
    found = scan(docs, benchmark, size).filter("contaminated").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans").distinct()
    # all columns travel in one, so that no name can clash
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(words(F.col("text"))).alias("key"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("key") == F.col("h"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if remove == "documents":
        return keyed.join(found, same, "left_anti").select(*(v.alias(c) for c, v in own.items()))
    parts = F.regexp_extract_all(own["text"], F.lit(f"{_BREAK}*{_WORD}"), F.lit(0))
    kept = F.filter(parts, lambda x, k: ~F.exists("spans", lambda s: (k + 1 >= s["start"]) & (k + 1 < s["end"])))
    tail = F.regexp_extract(own["text"], rf"(?<!{_BREAK}){_BREAK}*\z", 0)
    own["text"] = F.when(F.col("spans").isNull(), own["text"]).otherwise(F.concat(F.array_join(kept, ""), tail))
    return keyed.join(found, same, "left").select(*(v.alias(c) for c, v in own.items()))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_LOWER.upper()}', '{_LOWER}'), '{_GAP}'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bw),
lens AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM dw) dw JOIN g ON g.gram = dw.gram AND g.n = dw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": ORACLE}
