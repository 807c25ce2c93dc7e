"""FASTQ (SC-19): records of four lines from splits that may cut them anywhere; reads by name (RD-15, SC-22)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .regions import Region, in_region

_PART = "file string, block long, line long, name string, seq string, qual string"


def _first(lines: list[str]) -> int | None:
    """The place of the first line that begins a record: only there, a line of @ is two before one of +, since sequences begin
    with neither. None if too few lines are left to tell."""
    for i in range(len(lines) - 2):
        if lines[i].startswith("@") and lines[i + 2].startswith("+"):
            return i
    return None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each split, and on their own the lines before its first and behind its last, numbered in the split."""
    where, number, head, record, inside, out = None, 0, [], [], False, []

    def rows():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], [x.split()[0] for x in _PART.split(", ")])

    def loose(lines, first):
        out.extend((*where, first + i, x, None, None) for i, x in enumerate(lines))

    def end():
        loose(record if inside else head, number - len(record if inside else head))

    for batch in batches:
        for value, file, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, block) != where:
                if where:
                    end()
                where, number, head, record, inside = (file, block), 0, [], [], False
            number += 1
            line = value.rstrip("\r\n")
            if not inside:
                head.append(line)
                if (at := _first(head)) is not None:
                    loose(head[:at], number - len(head))
                    record, head, inside = head[at:], [], True
            else:
                record.append(line)
            if len(record) == 4:
                out.append((*where, None, record[0].strip(), record[1].strip(), record[3].strip()))
                record = []
        if len(out) > 4096:
            yield rows()
    if where:
        end()
    if out:
        yield rows()


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """SC-19: (name with its @, seq, qual) of each record; of a last one that is cut short, what it lacks is null.

    Only the lines at the edges of splits are shuffled, seven of each at most: records before them have four lines each, so these lines in
    the file's order are records again."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    parts = lines.mapInArrow(_parts, _PART)
    whole = parts.filter("line IS NULL").select("name", "seq", "qual")
    at = F.row_number().over(Window.partitionBy("file").orderBy("block", "line")) - 1
    edges = parts.filter("line IS NOT NULL").select("file", "name", at.alias("at"))
    line = lambda k: F.max(F.when(F.col("at") % 4 == k, F.trim("name")))
    joined = edges.groupBy("file", F.floor(F.col("at") / 4).alias("record")).agg(line(0).alias("name"), line(1).alias("seq"), line(3).alias("qual"))
    return whole.unionByName(joined.filter("name <> '' OR seq IS NOT NULL").select("name", "seq", "qual"))


def count_records(spark: SparkSession, path: str) -> int:
    """SC-19: lines over four; an error where they don't divide."""
    n = spark.read.text(path).count()
    if n % 4:
        raise ValueError(f"{n} lines don't divide into records of four")
    return n // 4


def plain_name(name: str = "name"):
    """A read's name without @, what follows a space, and /1 or /2."""
    return F.regexp_replace(F.regexp_replace(F.col(name), r"^@", ""), r"(/[12])?(\s.*)?$", "")


def of_alignments(fastq: DataFrame, alignments: DataFrame, region: str | Region | None = None) -> DataFrame:
    """RD-15: FASTQ records of reads that are aligned in a region: a semi-join by plain names."""
    wanted = in_region(alignments.filter("chrom IS NOT NULL"), region).select(plain_name().alias("_n"))
    return fastq.withColumn("_n", plain_name()).join(wanted, "_n", "left_semi").drop("_n")


def unaligned(alignments: DataFrame) -> DataFrame:
    """SC-22, RD-07: (name, seq, qual) of reads that are not mapped."""
    return alignments.filter(F.col("flag").bitwiseAND(F.lit(4)) != 0).select(F.concat(F.lit("@"), "name").alias("name"), "seq", "qual")
