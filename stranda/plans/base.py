"""What the query modules share: registration, and the fixtures as CTEs of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import EXON, FEAT, GENE, IV, READS, SIGNAL, VAR, fixture

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(name: str, sql: str):
    """Registers a function of (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        ALL[name] = (f, sql)
        return f

    return add


def get(*sqls: str):
    return lambda spark, sf_dir: [fixture(spark, sf_dir, s) for s in sqls]


WITH = f"WITH f AS ({FEAT}), i AS ({IV}), g AS ({GENE}), s AS ({SIGNAL}), r AS ({READS}), v AS ({VAR}), e AS ({EXON}) "
OVER = "f.chrom = i.chrom AND f.start_ <= i.end_ AND i.start_ <= f.end_ AND f.start_ <= f.end_"
