"""A text pipeline of five operators: language, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents but for the last. A stage's
result is written as Parquet to the shared checkpoint folder and read again as the next stage's docs.

Null or letterless texts go with the first stage. Repeated rows and ties: the first row by doc_id stays, one of equal rows. Texts
are taken whole, whatever their length. An empty table gives no rows. Columns of any further name are kept, until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stranda.llm import op3_language, op4_ngram_join, op6_decontaminate, op8_pii, op10_packing
from stranda.llm.common import stored, table

#: Near copies share 80 % of their five-word shingles at least; op4_ngram_join alone is bound to 3 words and 90 %.
WORDS, LEAST = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go; the model is learned from docs."""
    return op3_language.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row with the least doc_id stays, those without one last; of rows without a word, each
    (doc_id, text), and all without doc_id. Texts are known by a 64-bit hash, so rows of one doc_id with other texts are apart."""
    # null text has a hash of its own; all columns travel in one, so that no name can clash
    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64(text).alias("key"), worded.alias("worded"))
    roots = op4_ngram_join.component_keys(docs.select(F.xxhash64(text).alias("doc_id"), "text"), size=WORDS, least=LEAST).withColumnRenamed("doc_id", "key")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("d"), "key")
    first = keyed.select("doc_id", "key").join(roots, "key").groupBy("root").agg(F.min(rank).alias("r")).select("r.key", "r.d")
    kept = keyed.filter("worded").join(first, "key").filter(F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["key"])
    rest = keyed.filter("NOT worded")
    rest = rest.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "key"]).select("row").unionByName(rest.filter("doc_id IS NULL").select("row"))
    return kept.select("row").unionByName(rest).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return op6_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is counted anew."""
    out = op8_pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, one row for each piece."""
    return op10_packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("packing", packing)]

#: Learning, boosting and tokenizing can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
