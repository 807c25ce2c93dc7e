"""What a located table holds (SK-03), and exponential decay fitted by group (AG-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import islands


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """SK-03: a row for each column: n (values that aren't null), n_distinct, top (the most frequent as text; of equals the least) and top_n,
    and of numbers mean, sd, least and most.

    All columns are counted in one shuffle of (column, value), pre-aggregated, so that a frequent value is one row of each task."""
    names = columns or df.columns
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
    values = df.select(F.inline(F.array(*map(pair, names)))).groupBy("column", "value").agg(F.count("value").alias("k"))
    seen = F.col("value").isNotNull()
    counts = values.groupBy("column").agg(F.sum("k").alias("n"), F.count("value").alias("n_distinct"), F.min(F.when(seen, F.struct((-F.col("k")).alias("k"), "value"))).alias("top"))
    measures = {"mean": F.avg, "sd": F.stddev_samp, "least": F.min, "most": F.max}
    wide = df.agg(*(f(F.col(c).cast("double")).alias(f"{m}_{i}") for i, c in enumerate(names) if c in numeric for m, f in measures.items()), F.lit(1).alias("_one"))
    row = lambda i, c: F.struct(F.lit(c).alias("column"), *((F.col(f"{m}_{i}") if c in numeric else F.lit(None).cast("double")).alias(m) for m in measures))
    long = wide.select(F.inline(F.array(*(row(i, c) for i, c in enumerate(names)))))
    empty = F.coalesce("n", F.lit(0).cast("long"))
    return long.join(counts, "column", "left").select("column", empty.alias("n"), F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"), F.col("top.value").alias("top"), (-F.col("top.k")).alias("top_n"), *measures)


def located(df: DataFrame) -> DataFrame:
    """SK-03: one row of n, n_merged, contains_overlapping (fewer islands than intervals that aren't empty) and contains_empty."""
    full = df.agg(F.count("*").alias("n"), F.count_if(F.col("start_") > F.col("end_")).alias("n_empty"))
    part = islands.merge(df, ["chrom"]).agg(F.count("*").alias("n_merged"))
    both = full.withColumn("_", F.lit(1)).join(part.withColumn("_", F.lit(1)), "_")
    return both.select("n", "n_merged", (F.col("n") - F.col("n_empty") > F.col("n_merged")).alias("contains_overlapping"), (F.col("n_empty") > 0).alias("contains_empty"))


def fit_decay(df: DataFrame, by: list[str], t: str, y: str, start: float = 1.0, steps: int = 200) -> DataFrame:
    """AG-09: (by..., k, half_life): the k for which exp(-k t) has the least squared distance from y, by Newton's method from `start`.

    Only each time's number and mean of y matter, so rows are averaged by time first; a group's distinct times, not its rows, are held
    at once. Steps go downhill and are 0.5 at most, and halve from the hundredth on; groups without a time other than 0 give null."""
    points = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(t).cast("double").alias("t")).agg(F.count("*").cast("double").alias("n"), F.avg(y).alias("y"))
    grouped = points.groupBy(*by).agg(F.collect_list(F.struct("t", "n", "y")).alias("p"))

    def over(k: Column, term) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, p: s + term(p, F.exp(-k * p["t"])))

    def slope(k: Column) -> Column:
        return over(k, lambda p, e: p["n"] * p["t"] * e * (p["y"] - e))

    def bend(k: Column) -> Column:
        return over(k, lambda p, e: p["n"] * p["t"] * p["t"] * e * (2 * e - p["y"]))

    def step(k: Column, i: Column) -> Column:
        most = F.when(i < 100, F.lit(0.5)).otherwise(F.pow(F.lit(0.5), (i - 98).cast("double")))
        change = -slope(k) / F.nullif(F.abs(bend(k)), F.lit(0.0))
        return k + F.greatest(-most, F.least(change, most))

    moves = F.exists("p", lambda p: p["t"] != 0)
    k = F.when(moves, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(float(start)), step))
    return grouped.select(*by, k.alias("k")).withColumn("half_life", F.lit(0.6931471805599453) / F.nullif("k", F.lit(0.0)))
