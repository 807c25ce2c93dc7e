"""What the text operators share: the cluster's checkpoint folder, and word hashes of whole Arrow columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"  # the contract's white space
_SEGMENT = 1 << 20  # bytes hashed at a time; bounds the temporaries
_ROW_GROUP = 16 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only on a local master (tests), a temporary one is made where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stranda-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of the sums below counts."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Texts(NamedTuple):
    """The bytes of an Arrow text column: doc i is data[offsets[i]:offsets[i + 1]]; null is empty."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
        return cls(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)

    def per_doc(self, table: np.ndarray) -> np.ndarray:
        """For each doc, the sum of table[byte] over its bytes."""
        out = np.zeros(len(self.offsets) - 1, np.int64)
        full = np.flatnonzero(np.diff(self.offsets))
        if len(full):
            lo, hi = self.offsets[0], self.offsets[-1]
            out[full] = np.add.reduceat(table[self.data[lo:hi]], self.offsets[full] - lo, dtype=np.int64)
        return out


class Words(NamedTuple):
    """Of all docs, in order: hash is each word's 64-bit hash, doc its row."""

    hash: np.ndarray
    doc: np.ndarray


def _segments(word: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about _SEGMENT bytes that split no word (a longer word makes a longer segment)."""
    lo, n = 0, len(word)
    while lo < n:
        hi = min(lo + _SEGMENT, n)
        while hi < n and word[hi] and not starts[hi]:
            gaps = np.flatnonzero(~word[hi : hi + _SEGMENT] | starts[hi : hi + _SEGMENT])
            hi = hi + int(gaps[0]) if len(gaps) else min(hi + _SEGMENT, n)
        yield lo, hi
        lo = hi


def word_hashes(texts: Texts, lower: bool = False) -> Words:
    """Words are maximal runs of bytes outside SPACES. lower: A-Z count as a-z.

    A word's hash is a polynomial of its bytes, taken for all words of a segment at once."""
    value = np.arange(1, 257, dtype=np.uint64)
    if lower:
        value[65:91] = value[97:123]
    value[list(SPACES)] = 0
    base, end = int(texts.offsets[0]), int(texts.offsets[-1])
    data = texts.data[base:end]
    n = len(data)
    word = value[data] > 0 if n < _SEGMENT else (value > 0)[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets - base] = True
    edge = edge[:n]
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:]
    hashes, at, powers = [], [], np.ones(64, np.uint64)
    powers[1:] = _PRIME
    powers = np.cumprod(powers)
    for lo, hi in _segments(word, edge):
        starts = np.flatnonzero(first[lo:hi])
        if not len(starts):
            continue
        a = int(starts[0])
        position = np.arange(a, hi - lo) - np.repeat(starts, np.diff(np.append(starts, hi - lo)))
        longest = int(position.max()) + 1
        if longest > len(powers):
            powers = np.ones(longest, np.uint64)
            powers[1:] = _PRIME
            powers = np.cumprod(powers)
        hashes.append(mix64(np.add.reduceat(value[data[lo + a : hi]] * powers[position], starts - a)))
        at.append(starts + lo)
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    at = np.concatenate(at)
    return Words(np.concatenate(hashes), np.searchsorted(texts.offsets - base, at, side="right") - 1)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each run of size words within one doc."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, factor = np.zeros(n, np.uint64), np.uint64(1)
    for k in range(size):
        total = total + words.hash[k : k + n] * factor
        factor = np.uint64(int(factor) * 0xD6E8FEB86659FD93 & (2**64 - 1))
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return mix64(total[at]), at


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of the column, so long texts don't pile up."""
    for batch in batches:
        size = Texts.of(batch.column(batch.schema.get_field_index(column))).offsets
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def stored(df: DataFrame) -> DataFrame:
    """As cut(), in columns: a Parquet table in the shared checkpoint folder, for what is read more than once or in part.

    Small row groups keep what a task holds before it writes small."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stranda-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored(), once all that was made of them is written, and frees the shuffle files of the steps up to here.

    Spark's cleaner deletes a shuffle when the driver collects what refers to it, which on a large heap may be after the whole job."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()  # Python's handles of frames are in cycles, and hold their plans
        tables[0].sparkSession._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b), both long: (node, root), root the least node; nodes without a link are absent.

    Large-star and small-star rounds (Kiveris et al. 2014) on the link table, each cut off in the shared folder; a node's
    links are only reduced to their minimum, never gathered."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def crc32_sql(number: str) -> str:
    """DuckDB SQL for the CRC-32 of a whole number's decimal digits."""
    digits = f"list_transform(range(1, length({number}::VARCHAR) + 1), lambda i: ascii(substr({number}::VARCHAR, i, 1))::BIGINT)"
    bits = "list_reduce(range(0, 8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, d))"
    return f"xor(list_reduce({digits}, lambda c, d: {bits}, 4294967295::BIGINT), 4294967295)"
