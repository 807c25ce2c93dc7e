"""Interval, transcript, read, variant and sequence tables derived from the star-schema tables, in SQL both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FEAT = """SELECT p_partkey AS uid, 'chr' || cast(p_partkey % 5 + 1 AS string) AS chrom,
  p_partkey * 4 + 1 AS start_, p_partkey * 4 + cast(p_size AS bigint) AS end_,
  CASE p_size % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand, p_brand AS name, p_retailprice AS score FROM part"""
IV = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'chr' || cast(l_suppkey % 5 + 1 AS string) AS chrom,
  l_partkey * 4 + l_linenumber AS start_, l_partkey * 4 + l_linenumber + cast(l_quantity AS bigint) - 1 AS end_,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' END AS strand, l_extendedprice AS score FROM lineitem"""
EXON = """SELECT o_custkey AS gene_id, o_orderkey AS tx_id, rnk, 'chr' || cast(o_custkey % 5 + 1 AS string) AS chrom,
  CASE o_custkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand,
  o_custkey * 2000 + (o_orderkey % 10) * 50 + rnk * 100 + l_partkey % 51 AS start_,
  o_custkey * 2000 + (o_orderkey % 10) * 50 + rnk * 100 + l_partkey % 51 + cast(l_quantity AS bigint) - 1 AS end_, o_orderstatus AS tx_type
  FROM (SELECT o_custkey, o_orderkey, o_orderstatus, l_partkey, l_quantity, cast(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS bigint) AS rnk FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x"""
SIGNAL = """SELECT chrom, j * 20 + 1 AS start_, j * 20 + 20 AS end_, cast(cast(floor(j / 3.0) AS bigint) % 4 AS double) AS value
  FROM (SELECT 'chr' || cast(p_partkey % 5 + 1 AS string) AS chrom, cast(floor(p_partkey / 5.0) AS bigint) AS j FROM part) x WHERE j % 7 <> 0"""
READS = """SELECT event_id AS uid, 'r' || cast(pid AS string) AS name, 'chr' || cast(pid % 5 + 1 AS string) AS chrom, start_,
  start_ + CASE event_id % 5 WHEN 0 THEN 32 WHEN 1 THEN 42 WHEN 2 THEN 26 WHEN 3 THEN 34 ELSE 30 END - 1 AS end_,
  CASE event_id % 5 WHEN 0 THEN '32M' WHEN 1 THEN '12M10N20M' WHEN 2 THEN '6S26M' WHEN 3 THEN '16M2D16M' ELSE '10M2I20M' END AS cigar,
  1 + CASE WHEN event_id % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN event_type IN ('view', 'error') THEN 16 ELSE 0 END
    + CASE WHEN event_id % 11 = 0 THEN 256 ELSE 0 END + CASE WHEN event_id % 13 = 0 THEN 1024 ELSE 0 END + CASE WHEN event_id % 97 = 0 THEN 4 ELSE 0 END AS flag,
  event_id % 61 AS mapq, event_id % 3 + 1 AS nh, translate(md5(cast(event_id AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, md5('q' || cast(event_id AS string)) AS qualhex
  FROM (SELECT event_id, event_type, cast(floor(event_id / 2.0) AS bigint) AS pid, user_id * 20 + cast(floor(value) AS bigint) + 1 AS start_ FROM events) x"""
VAR = """SELECT p_partkey AS uid, 'chr' || cast(p_partkey % 5 + 1 AS string) AS chrom, p_partkey * 4 + 3 AS pos,
  CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'T' WHEN 2 THEN 'ACG' WHEN 3 THEN 'A' WHEN 4 THEN 'C' ELSE 'G' END AS ref,
  CASE p_size % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'ATT' WHEN 4 THEN '<DEL>' ELSE 'C,T' END AS alt,
  CASE p_partkey % 10 WHEN 0 THEN 'LowQual' WHEN 1 THEN '.' ELSE 'PASS' END AS filter_, 'DP=' || cast(p_size AS string) || ';SVTYPE=DEL;END=' || cast(p_partkey * 4 + 23 AS string) || ';DB' AS info,
  CASE p_partkey % 7 WHEN 0 THEN './.' WHEN 1 THEN '0/0' WHEN 2 THEN '0/1' WHEN 3 THEN '1/1' WHEN 4 THEN '1|0' WHEN 5 THEN './1' ELSE '1/2' END AS gt FROM part"""
GENE = f"SELECT gene_id, min(chrom) AS chrom, min(start_) AS start_, max(end_) AS end_, min(strand) AS strand FROM ({EXON}) e GROUP BY gene_id"
GENOME = """SELECT chrom, j * 32 AS at_, seq FROM (SELECT 'chr' || cast(p_partkey % 5 + 1 AS string) AS chrom, cast(floor(p_partkey / 5.0) AS bigint) AS j,
  translate(md5('g' || cast(p_partkey AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part) x WHERE j % 37 <> 5"""
#: the exons, each gene moved to one of 40 places of the genome
NEAR = f"SELECT gene_id, tx_id, rnk, chrom, strand, start_ - gene_id * 1800 - cast(floor(gene_id / 40.0) AS bigint) * 8000 AS start_, end_ - gene_id * 1800 - cast(floor(gene_id / 40.0) AS bigint) * 8000 AS end_ FROM ({EXON}) e"
SOURCES = ("part", "lineitem", "orders", "events", "documents")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a fixture's SQL over the Parquet tables of sf_dir."""
    pattern = rf"\b(FROM|JOIN) ({'|'.join(SOURCES)})\b"
    used = {m[2] for m in re.finditer(pattern, sql)}
    return spark.sql(re.sub(pattern, r"\1 {\2}", sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
