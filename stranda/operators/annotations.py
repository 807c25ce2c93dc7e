"""Annotations of features by key (SK-10, SK-11): a stored table of (key, name, value) that is merged into by rewriting only the parts it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import cut

#: what tells features of any build apart
KEY = ("feature_type", "id", "chrom", "start_", "end_", "strand")
BUCKETS = 256


def key() -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in KEY))


def of_features(features: DataFrame, column: str = "attrs", excluded: tuple[str, ...] = ("dna_seq",)) -> DataFrame:
    """SK-11: (key, name, value) of a column that maps names to values, without the names excluded (T52: none of them is put in)."""
    each = features.select(key().alias("key"), F.explode(column).alias("name", "value"))
    return each.filter(~F.col("name").isin(list(excluded))) if excluded else each


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("key", "name", F.col("value").cast("string").alias("value"), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def save(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A new table; of equal (key, name) the greatest value counts."""
    one = _placed(rows).groupBy("key", "name", "bucket").agg(F.max("value").alias("value"))
    one.repartition("bucket").sortWithinPartitions("bucket", "key", "name").write.partitionBy("bucket").mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("key", "name", "value")


def merge(spark: SparkSession, path: str, rows: DataFrame, update: bool = False) -> None:
    """SK-11: stored annotations of the keys in rows become those of rows; with update, stored ones of other names stay.

    Only buckets with a key of rows are read and written again; what is written is complete before the first file is replaced."""
    new = _placed(rows).groupBy("key", "name", "bucket").agg(F.max("value").alias("value"))
    touched = new.select("bucket").distinct()
    # at most BUCKETS rows
    old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").select("key", "name", "bucket", "value")
    kept = old.join(new.select(*(["key", "name"] if update else ["key"])).distinct(), ["key", "name"] if update else "key", "left_anti")
    merged = cut(kept.select("key", "name", "bucket", "value").unionByName(new))
    merged.repartition("bucket").sortWithinPartitions("bucket", "key", "name").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)


def annotate(features: DataFrame, rows: DataFrame, column: str = "annotations") -> DataFrame:
    """SK-11: features with a map of their annotations, empty where there are none."""
    found = rows.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(column))
    return features.withColumn("key", key()).join(found, "key", "left").withColumn(column, F.coalesce(column, F.expr("cast(map() AS map<string,string>)"))).drop("key")


def unknown(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of annotations that none of the features has."""
    return rows.select("key").distinct().join(features.select(key().alias("key")), "key", "left_anti")
