"""Lexical retrieval packing: each window is filled with unused neighbours of its seed from a sharded BM25 index.

1. Every whole document becomes byte-level BPE ids and a final id 1. What fills whole windows is cut off its front and
   needs no neighbours; the rest (under WINDOW ids) is to be packed.
2. Document frequencies of all ids, the number of documents and their mean length are counted over the whole corpus; ids
   are BPE ids, so this is a table of VOCABULARY entries at most.
3. The rests are dealt by a hash to shards of about SHARD documents. Each shard builds an inverted index of BM25 weights
   and, seed by seed, asks it, with all ids of the seed, for the unused documents closest to it; they fill the window, the last one is cut
   where the window ends, and what is left of it seeds the next window. So only a shard's last window is padded.

A shard is bounded by its number of documents and by WINDOW ids for each, whatever the corpus holds; copies spread over
shards, for rows are dealt by a hash of their place. So neighbours are the best of the seed's own shard only, a
share of the corpus that falls as it grows; README.md has what that costs. Nothing here retrieves over all rests.

Null or empty text: the one id 1. Null doc_id: packed as any other. Repeated rows: each is packed. Ties between
neighbours go to the lower place in the shard's order (doc_id, start, ids). An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, table

WINDOW = 2048
END = 1
SHARD = 1024  # rests in a shard, about
K1, B = 1.2, 0.75
VOCABULARY = 1 << 16
_LONG_BLANK = re.compile(r"\s{10000}")  # the faster library backtracks through white space, and gives up


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary and merges of a byte-level BPE tokenizer file, run by the faster of two libraries that give the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is no byte-level BPE without a prefix space")
    if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
        raise ValueError(f"{path} has a normalizer or words of its own")
    if max(spec["model"]["vocab"].values()) >= VOCABULARY:
        raise ValueError(f"{path} has ids of over 16 bits")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    # fixed values: the printable characters that byte-level BPE writes as themselves; the other bytes follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pre-tokenizer's words
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), set(special)


@lru_cache(maxsize=2)
def reference(path: str):
    """The tokenizer file itself, for texts that the faster library can't take."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text without added special tokens, then END; a special token's own string in the text is that token."""
    bpe, special = encoder(path)
    if _LONG_BLANK.search(text):
        return np.array([*reference(path).encode(text, add_special_tokens=False).ids, END], "<u2")
    if any(x in text for x in special):
        return np.array([*bpe.encode(text, allowed_special=special), END], "<u2")
    return np.append(bpe.encode_to_numpy(text, disallowed_special=()), np.uint32(END)).astype("<u2")


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in pieces(batches, "text"):
            ids, out = batch.column(0).to_pylist(), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                x = encode(text or "", path)
                df[np.unique(x)] += 1
                n, total = n + 1, total + len(x)
                whole = len(x) // WINDOW * WINDOW
                for at in range(0, whole, WINDOW):
                    out.append((ids[i], at, WINDOW, zlib.crc32(x[at : at + WINDOW].astype("<u4").tobytes()), len(x), None, None, None))
                if whole < len(x):
                    rest = x[whole:]
                    out.append((ids[i], whole, len(rest), 0, len(x), rest.tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)] if out else [pa.array([], t) for t in _TYPES], [*_NAMES, "term", "n"])
        at = np.flatnonzero(df)
        none = [pa.nulls(len(at) + 2, t) for t in _TYPES[: len(_NAMES)]]
        yield pa.RecordBatch.from_arrays([*none, pa.array([*at, -1, -2], pa.int32()), pa.array([*df[at], n, total], pa.int64())], [*_NAMES, "term", "n"])

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
_TOKENS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, term int, n long"
_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents: whole windows with their checksum, and the rest with its ids (16 bits each).

    Beside them, rows (term, n): of each partition, in how many documents an id is; at -1 their number, at -2 their length."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tokenize(tokenizer or _default_tokenizer()), _TOKENS)


def statistics(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """(idf of each id, mean length) over all whole documents. At most VOCABULARY + 2 sums reach the driver."""
    found = tokens.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n, total = np.zeros(VOCABULARY), 0, 0
    for term, count in found:
        if term >= 0:
            df[term] = count
        elif term == -1:
            n = count
        else:
            total = count
    return np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), total / max(n, 1)


class Index:
    """BM25 weights of a shard's documents, by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        counted = [np.unique(x, return_counts=True) for x in docs]
        size = np.array([len(x) for x, _ in counted])
        term, tf = (np.concatenate(x) if docs else np.zeros(0, np.int64) for x in (list(x) for x in zip(*counted, strict=True)))
        doc = np.repeat(np.arange(len(docs)), size)
        length = np.array([len(x) for x in docs], np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.query = [t for t, _ in counted]
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        """Of each document, the sum of its weights of the seed's ids, all of them."""
        terms = self.query[seed]
        lo, n = self.at[terms], self.at[terms + 1] - self.at[terms]
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        return np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """(doc, start in it, length, sequence, offset) of each piece: greedy filling by BM25 neighbours of the seed."""
    index, unused, out = Index(docs, idf, mean), np.ones(len(docs), bool), []
    sequence, room, next_seed = 0, WINDOW, 0
    carry: tuple[int, int] | None = None
    while True:
        if carry is None:
            while next_seed < len(docs) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return out
            carry = (next_seed, 0)
            unused[next_seed] = False
        seed, start = carry
        carry = None
        score = None
        doc = seed
        while True:
            take = min(len(docs[doc]) - start, room)
            out.append((doc, start, take, sequence, WINDOW - room))
            room -= take
            if start + take < len(docs[doc]):
                carry = (doc, start + take)
            if not room:
                sequence, room = sequence + 1, WINDOW
                break
            if score is None:
                score = index.scores(seed)
                ranked = np.lexsort((np.arange(len(docs)), -score))
                place = 0
            while place < len(docs) and not unused[ranked[place]]:
                place += 1
            if place == len(docs):
                return out
            doc, start = int(ranked[place]), 0
            unused[doc] = False


def _pack(idf, mean: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        doc_id, start, length, crc, total, ids = (rows.column(c).to_pylist() for c in _NAMES)
        order = sorted(range(len(ids)), key=lambda i: (doc_id[i] is not None, doc_id[i] or 0, start[i], ids[i] or b""))
        # a whole window is a sequence of its own; the shard's other sequences follow
        whole, rest = [i for i in order if ids[i] is None], [i for i in order if ids[i] is not None]
        base = key[0].as_py() << 32
        out = [(doc_id[i], start[i], length[i], crc[i], total[i], base + k, 0) for k, i in enumerate(whole)]
        docs = [np.frombuffer(ids[i], "<u2") for i in rest]
        for d, s, n, sequence, offset in pack_shard(docs, idf.value, mean) if docs else ():
            i = rest[d]
            out.append((doc_id[i], start[i] + s, n, zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()), total[i], base + len(whole) + sequence, offset))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _OUT)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = cut(tokenized(docs, tokenizer))
    idf, mean = statistics(tokens)
    parts = tokens.filter("term IS NULL").drop("term", "n")
    # whole windows have no ids and need no neighbours
    shards = max(1, -(-parts.filter("ids IS NOT NULL").count() // shard))
    # tokens are cut off, so places in their partitions hold; repeated rows spread like others
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(spark.sparkContext.broadcast(idf), mean), _PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
