"""Exact k-mers: positions in a genome's chunks, and what spliced transcripts they hit, by equi-joins on words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.sequence import reverse_complement
from .genome import CHUNK
from .steps import cut

MOST, LONGEST = 1 << 17, 1 << 7  # k-mers and their letters that tasks hold; if there are more or longer ones, all are joined
LETTERS = 1 << 18  # letters of sequences that are looked up at once
TABLE = 1 << 22  # entries of a table of all heads


def words(seq: Column, k: Column) -> Column:
    """Array of (at: 1-based, word: k letters) of a sequence; none of a shorter one."""
    n = F.length(seq) - k + 1
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("at"), F.substring(seq, i, k).alias("word")))
    return F.when(n > 0, each)


def oriented(kmers: DataFrame, both_strands: bool = False) -> DataFrame:
    """kmer, strand, letters: upper-case k-mers as they are searched; on - the reverse complement, unless it is the same."""
    plain = kmers.select(F.upper("kmer").alias("kmer")).distinct().filter("kmer <> ''")
    out = plain.select("kmer", F.lit("+").alias("strand"), F.col("kmer").alias("letters"))
    if both_strands:
        turned = plain.select("kmer", F.lit("-").alias("strand"), reverse_complement(F.col("kmer")).alias("letters")).filter("letters <> kmer")
        out = out.unionByName(turned)
    return out


@F.pandas_udf(ArrayType(LongType()))
def _apart(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of sorted (place, length) pairs that overlap in a chain: from the left, those that don't overlap the one taken before."""

    def take(pairs) -> list[int]:
        out, free = [], None
        for x in pairs:
            if free is None or x["pos"] >= free:
                out.append(x["pos"])
                free = x["pos"] + x["k"]
        return out

    for series in places:
        yield series.map(take)


def find_positions(genome: DataFrame, kmers: DataFrame, both_strands: bool = False, overlapping: bool = False, size: int = CHUNK) -> DataFrame:
    """SQ-07, SQ-08: (chrom, kmer, strand, pos: 1-based first letter) of exact matches, whatever the case of letters.

    kmers has a column kmer, of any lengths. A chunk's words are those that begin in it (with the next chunk's first letters behind), and meet
    the k-mers of their length by an equi-join: Spark broadcasts the k-mers if their size allows. Matches of one k-mer on one strand
    don't overlap each other, counted from the left, unless overlapping is set."""
    found = oriented(kmers, both_strands).withColumn("k", F.length("letters"))
    sizes = found.select("k").distinct()
    longest = found.agg(F.max("k").alias("longest"))
    head = genome.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.col("seq").alias("next"))
    # a row of one number and the distinct lengths of k-mers: no larger than the k-mers
    at = genome.join(head, ["chrom", "chunk"], "left").join(F.broadcast(longest))
    text = at.select("chrom", "chunk", F.upper(F.concat("seq", F.coalesce(F.expr("left(next, longest - 1)"), F.lit("")))).alias("text"))
    each = text.join(F.broadcast(sizes)).select("chrom", "chunk", "k", F.explode(words(F.col("text"), F.col("k"))).alias("w"))
    # words that begin in the next chunk's letters are that chunk's
    mine = each.filter(F.col("w.at") <= size).select("chrom", "chunk", (F.col("chunk") * size + F.col("w.at")).alias("pos"), F.col("w.word").alias("letters"))
    hits = mine.join(found, "letters").select("chrom", "chunk", "kmer", "strand", F.col("k").cast("long").alias("k"), "pos")
    if overlapping:
        return hits.select("chrom", "kmer", "strand", "pos")
    # chains of overlapping matches: a chain begins where the match before ends earlier; chunks hand on their last begin
    by = ["chrom", "kmer", "strand"]
    inside = Window.partitionBy(*by, "chunk").orderBy("pos")
    seen = hits.withColumn("gap", F.col("pos") - F.lag("pos").over(inside))
    edge = seen.groupBy(*by, "chunk").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max(F.when(F.col("gap") >= F.col("k"), F.col("pos"))).alias("inner"))
    along = Window.partitionBy(*by).orderBy("chunk")
    opens = F.col("first") - F.lag("last").over(along) >= F.length("kmer")
    edge = edge.withColumn("opens", F.coalesce(opens, F.lit(True)))
    edge = edge.withColumn("begin", F.coalesce("inner", F.when(F.col("opens"), F.col("first"))))
    edge = edge.withColumn("open", F.when(F.col("opens"), F.col("first")).otherwise(F.last("begin", True).over(along.rowsBetween(Window.unboundedPreceding, -1))))
    chained = seen.join(edge.select(*by, "chunk", "open"), [*by, "chunk"])
    start = F.coalesce(F.max(F.when(F.col("gap") >= F.col("k"), F.col("pos"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("open"))
    chains = chained.withColumn("start", start).groupBy(*by, "start").agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("places"))
    alone = F.size("places") == 1
    single = chains.filter(alone).select(*by, F.get("places", 0)["pos"].alias("pos"))
    return single.unionByName(chains.filter(~alone).select(*by, F.explode(_apart("places")).alias("pos")))


def _distinct(x: np.ndarray) -> np.ndarray:
    """x sorted, each number once; several times as fast as np.unique."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _among(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where numbers stand among sorted ones, and whether they do."""
    place = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return place, known[place] == x


class _Lookup:
    """Which k-mers words are, exactly. The first letters of a word, its head, are looked up in a table of all heads; a prefix that some k-mer
    has is a number, and the number of a longer one is found by it and the next block of letters."""

    def __init__(self, found: list[tuple[int, str]]):
        """found: a k-mer's number and letters that are searched for it."""
        self.count = 1 + max((i for i, _ in found), default=-1)
        self.bits = self.count.bit_length()
        letters = np.array(sorted({ord(c) for _, x in found for c in x}), dtype=np.int64)
        self.base = max(2, len(letters) + 1)  # the last one is for all other letters
        self.index = np.full(int(letters.max(initial=255)) + 2, len(letters), dtype=np.int32)
        self.index[letters] = np.arange(len(letters))
        self.most = max(1, int(np.log(TABLE) / np.log(self.base)))
        owners: dict[int, dict[str, list[int]]] = {}
        for i, x in found:
            owners.setdefault(len(x), {}).setdefault(x, []).append(i)
        columns = {k: self.index[np.frombuffer("".join(of).encode("utf-32-le"), dtype=np.uint32)].reshape(-1, k).T for k, of in owners.items()}
        self.heads = {n: self._table(n, [x for k, x in columns.items() if min(k, self.most) == n]) for n in {min(k, self.most) for k in owners}}
        self.of_length = {k: self._steps(k, columns[k], list(of.values())) for k, of in owners.items()}

    def _number(self, columns) -> np.ndarray:
        code = columns[0].copy()
        for x in columns[1:]:
            code *= self.base
            code += x
        return code

    def _table(self, n: int, texts: list[np.ndarray]) -> np.ndarray:
        known = np.unique(np.concatenate([self._number(x[:n]) for x in texts]))
        table = np.full(self.base**n, -1, dtype=np.int32)
        table[known] = np.arange(len(known))
        return table

    def _steps(self, k: int, x: np.ndarray, owners: list[list[int]]):
        n = min(k, self.most)
        prefix, size, steps = self.heads[n][self._number(x[:n])].astype(np.int64), int(self.heads[n].max()) + 1, []
        for at in range(n, k, self.most):
            known, block = np.unique(self._number(x[at : at + self.most]), return_inverse=True)
            both, prefix = np.unique(prefix * len(known) + block, return_inverse=True)
            steps.append((range(at, min(k, at + self.most)), known, both))
            size = len(both)
        # letters of several k-mers (one searched on +, others on -) have several layers
        layers = [np.full(size, -1, dtype=np.int64) for _ in range(max(map(len, owners)))]
        for p, of in zip(prefix, owners):
            for layer, i in zip(layers, of):
                layer[p] = i
        return n, steps, layers

    def pairs(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """row << bits | k-mer, distinct and sorted: x has the indices of letters and row their rows, which words don't cross."""
        out = []
        for k, (n, steps, layers) in self.of_length.items():
            m = len(x) - k + 1
            if m < 1:
                continue
            prefix = self.heads[n][self._number([x[i : i + m] for i in range(n)])]
            at = np.flatnonzero((prefix >= 0) & (row[:m] == row[k - 1 :]))
            prefix = prefix[at].astype(np.int64)
            for places, known, both in steps:
                block, there = _among(known, self._number([x[at + i] for i in places]))
                prefix, whole = _among(both, prefix * len(known) + block)
                at, prefix = at[there & whole], prefix[there & whole]
            for layer in layers:
                kmer = layer[prefix]
                held = kmer >= 0
                out.append(row[at[held]] << self.bits | kmer[held])
        return _distinct(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)

    def split(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and k-mers of pairs."""
        return pairs >> self.bits, pairs & (1 << self.bits) - 1

    def read(self, seqs: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """Of a column of arrays of strings, runs of rows (from, to) with about LETTERS letters and their pairs, rows counted from the run's first."""
        if not len(seqs):
            return
        per_row = np.diff(seqs.offsets.to_numpy())
        texts = seqs.flatten().cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        owner = np.repeat(np.arange(len(per_row)), per_row)
        last = np.concatenate(([0], np.cumsum(per_row)))
        weight = (ends[last] - ends[0]) // LETTERS
        edges = np.flatnonzero(np.diff(weight[:-1], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(per_row)]):
            s, e = last[a], last[b]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[s] : ends[e]]
            size = np.diff(ends[s : e + 1])
            if len(data) and data.max() > 127:
                whole = data.tobytes()
                at = ends[s : e + 1] - ends[s]
                size = np.array([len(whole[i:j].decode()) for i, j in zip(at, at[1:])], dtype=np.int64)
                data = np.minimum(np.frombuffer(whole.decode().encode("utf-32-le"), dtype=np.uint32), len(self.index) - 1)
            x = self.index[data]
            if per_row[a:b].max() < 2:
                yield a, b, self.pairs(x, np.repeat(owner[s:e] - a, size))
                continue
            # a row's sequences are kept apart by a letter of no k-mer
            yield a, b, self.pairs(np.insert(x, np.cumsum(size), self.base - 1), np.repeat(owner[s:e] - a, size + 1))


def targets(kmers: DataFrame, transcripts: DataFrame, both_strands: bool = False) -> DataFrame:
    """SQ-21: for each (kmer, tx_id, gene_id) one row: transcripts (tx_id, gene_id, seq: spliced) that hold the k-mer, and n_genes, the
    distinct genes of all of them; 1 tells a k-mer that hits one gene alone.

    Up to MOST k-mers of up to LONGEST letters are held by the tasks, which look up the words of the sequences: no word is shuffled, only
    sequences are, once for the genes. More or longer k-mers meet the words by joins."""
    found = oriented(kmers, both_strands)
    tx = transcripts.groupBy("tx_id", "gene_id").agg(F.collect_list(F.upper("seq")).alias("seqs"))
    few = found.select(*(F.left(c, F.lit(LONGEST + 1)).alias(c) for c in ("kmer", "letters"))).limit(MOST + 1).collect()
    if len(few) > MOST or any(len(r.letters) > LONGEST for r in few):
        return _joined(found, tx, both_strands)
    names = sorted({r.kmer for r in few})
    number = {k: i for i, k in enumerate(names)}
    spark = kmers.sparkSession
    lookup = spark.sparkContext.broadcast(_Lookup([(number[r.kmer], r.letters) for r in few]))
    tx = cut(tx)

    def genes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = lookup.value
        total, seen, last = np.zeros(look.count, dtype=np.int64), np.zeros(look.count, dtype=bool), None
        for batch in batches:
            for a, b, pairs in look.read(batch.column("seqs")):
                gene = batch.column("gene_id").slice(a, b - a)
                run = np.concatenate(([0], np.cumsum(pc.not_equal(gene[1:], gene[:-1]).to_numpy(zero_copy_only=False))))
                row, kmer = look.split(pairs)
                row, kmer = look.split(_distinct(run[row] << look.bits | kmer))
                if gene[0].as_py() != last:
                    seen[:] = False
                new = (row > 0) | ~seen[kmer]
                total += np.bincount(kmer[new], minlength=look.count)
                if run[-1]:
                    seen[:] = False
                seen[kmer[row == run[-1]]] = True
                last = gene[-1].as_py()
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["i", "n"])

    # a gene's rows are neighbours, so its k-mers are counted while they pass
    by_gene = tx.filter("gene_id IS NOT NULL").select("gene_id", "seqs").repartition("gene_id").sortWithinPartitions("gene_id")
    counted = by_gene.mapInArrow(genes, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n_genes = np.zeros(len(names), dtype=np.int64)
    n_genes[[r.i for r in counted]] = [r.n for r in counted]
    told = spark.sparkContext.broadcast((pa.array(names, pa.string()), n_genes))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, (words_, n) = lookup.value, told.value
        for batch in batches:
            for a, b, pairs in look.read(batch.column("seqs")):
                row, kmer = look.split(pairs)
                row = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([words_.take(pa.array(kmer)), batch.column("tx_id").take(row), batch.column("gene_id").take(row), pa.array(n[kmer])], ["kmer", "tx_id", "gene_id", "n_genes"])

    schema = StructType([StructField("kmer", StringType()), tx.schema["tx_id"], tx.schema["gene_id"], StructField("n_genes", LongType(), False)])
    return tx.mapInArrow(hits, schema)


def _joined(found: DataFrame, tx: DataFrame, both_strands: bool) -> DataFrame:
    """As targets, by joins on words: for any number of k-mers."""
    sizes = F.broadcast(found.select(F.length("letters").alias("k")).distinct())
    each = F.flatten(F.filter(F.transform("seqs", lambda seq: F.transform(words(seq, F.col("k")), lambda w: w["word"])), lambda x: x.isNotNull()))
    hits = tx.join(sizes).select("tx_id", "gene_id", F.explode(F.array_distinct(each)).alias("letters")).join(found, "letters").select("kmer", "tx_id", "gene_id")
    hits = hits.distinct() if both_strands else hits
    genes = hits.groupBy("kmer").agg(F.count_distinct("gene_id").alias("n_genes"))
    return hits.join(genes, "kmer")
