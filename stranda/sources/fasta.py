"""FASTA files as rows of sequence: split like any text, records put together again by sums over the splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = 1 << 16
_PART = "file string, block long, record long, chrom string, at long, seq string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, in its order: record 0 is what goes on from the split before, then those that begin here; at counts from the
    record's first base in the split. A record that begins has a row even without bases."""
    where, record, chrom, at, lines, held, out = None, 0, None, 0, [], 0, []

    def flush():
        nonlocal at, lines, held
        seq = "".join(lines)
        out.append((*where, record, chrom, at, seq))
        at, lines, held = at + len(seq), [], 0

    def batch():
        cols = list(zip(*out))
        out.clear()
        types = pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in _PART.split(", ")])

    for got in batches:
        for value, file, block in zip(*(got.column(i).to_pylist() for i in range(3))):
            if (file, block) != where:
                if where is not None:
                    flush()
                where, record, chrom, at = (file, block), 0, None, 0
            line = value.strip()
            if line.startswith(">"):
                flush()
                record, chrom, at = record + 1, (line[1:].split() or [""])[0], 0
            elif not line.startswith(";"):
                lines.append(line)
                held += len(line)
                if held >= SEGMENT:
                    flush()
        if len(out) > 16:
            yield batch()
    if where is not None:
        flush()
    if out:
        yield batch()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SC-06, SQ-13: (chrom, at, seq): segments of each record, at 0-based. Names end at the first space and must differ; letters are kept as they
    are. Splits are read on their own, whatever records they cut; what is carried from one to the next is a row for each split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    parts = lines.mapInArrow(_parts, _PART)
    # per split: does a record begin, the name of the last that does, and the bases it leaves to the next split
    length = F.length("seq").cast("long")
    sums = parts.groupBy("file", "block").agg(F.max(F.struct("record", "chrom")).alias("last"), F.sum(F.when(F.col("record") == 0, length).otherwise(0)).alias("head"), F.max(F.struct("record", (F.col("at") + length).alias("n"))).alias("tail"))
    by = Window.partitionBy("file").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col("last.record") > 0
    sums = sums.withColumns({
        "tail": F.when(begun, F.col("tail.n")).otherwise(F.col("head")),
        "begun": F.coalesce(F.sum(F.when(begun, 1).otherwise(0)).over(before), F.lit(0)),
        "name": F.last(F.when(begun, F.col("last.chrom")), True).over(before),
    })
    # the split in which the record begins belongs to those it goes on in
    run = sums.withColumn("run", F.sum(F.when(begun, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    total = run.withColumn("upto", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    carried = total.select("file", "block", "name", F.lag("upto").over(by).alias("base"))
    goes_on = F.col("record") == 0
    out = parts.join(carried, ["file", "block"])
    return out.select(F.when(goes_on, F.col("name")).otherwise(F.col("chrom")).alias("chrom"), (F.col("at") + F.when(goes_on, F.coalesce("base", F.lit(0))).otherwise(0)).alias("at"), "seq").filter("chrom IS NOT NULL AND seq <> ''")
