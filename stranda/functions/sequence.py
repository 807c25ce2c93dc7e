"""Sequence (SQ) and variant (VC) functions of Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """SQ-01: upper case; letters outside ACGTN become *."""
    known = F.regexp_replace(F.upper(seq), "[^ACGTN]", "*")
    return F.translate(F.reverse(known), "ACGT", "TGCA")


def gc_count(seq: Column) -> Column:
    """SQ-03: upper-case G and C."""
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))).cast("long")


def gc_fraction(seq: Column) -> Column:
    """SQ-03: null for an empty sequence."""
    return gc_count(seq) / F.nullif(F.length(seq), F.lit(0))


def longest_run(seq: Column, letters: str) -> Column:
    """SQ-06: length of the longest run of any of the letters; 0 without one."""
    runs = F.regexp_extract_all(seq, F.lit(f"[{re.escape(letters)}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("long")


def kmer_count(seq: Column, kmer: str) -> Column:
    """SQ-07: matches that don't overlap."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(kmer), F.lit("")))) / len(kmer)).cast("long")


def pad_n(seq: Column, length: int) -> Column:
    """SQ-10: N on both sides up to a length, the odd one on the right."""
    lack = F.greatest(F.lit(0), F.lit(length) - F.length(seq))
    left = F.floor(lack / 2).cast("int")
    return F.concat(F.repeat(F.lit("N"), left), seq, F.repeat(F.lit("N"), lack - left))


def windows(seq: Column, width: int, step: int) -> Column:
    """SQ-09: array of windows, the last filled up with N; it needs a letter of its own. None for an empty sequence."""
    full = F.floor((F.length(seq) - width) / step) + 1
    more = ((full - 1) * step + width < F.length(seq)) & (full * step < F.length(seq))
    n = F.when(F.length(seq) <= width, 1).otherwise(full + more.cast("int")).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rpad(F.substring(seq, i * step + 1, F.lit(width)), width, "N"))
    return F.when(F.length(seq) > 0, at).otherwise(F.expr("cast(array() AS array<string>)"))


def zygosity(gt: Column) -> Column:
    """VC-01: (zygosity, call): no call (0, 0), hom-ref (2, 0), hom (2, 1), mixed (1, 1)."""
    alleles = F.array_distinct(F.filter(F.split(gt, r"[/|]"), lambda a: a != "."))
    pair = lambda z, c: F.struct(F.lit(z).alias("zyg"), F.lit(c).alias("called"))
    return F.when(F.size(alleles) == 0, pair(0, 0)).when(F.size(alleles) > 1, pair(1, 1)).when(F.get(alleles, 0) == "0", pair(2, 0)).otherwise(pair(2, 1))


def complement(seq: Column) -> Column:
    """SQ-02."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGTN]", "*"), "ACGT", "TGCA")


def count_sites(seq: Column, sites: list[str]) -> Column:
    """SQ-04: how many of the restriction sites are in it."""
    return sum((F.contains(seq, F.lit(x)).cast("long") for x in sites), F.lit(0).cast("long"))


def longest_homopolymer(seq: Column) -> Column:
    """SQ-05: length of the longest run of one letter."""
    runs = F.regexp_extract_all(seq, F.lit(r"(.)\1*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("long")


def longest_runs(seq: Column) -> Column:
    """SQ-05, SQ-06: (hp, gc): lengths of the longest run of one letter and of the longest run of G and C."""
    return F.struct(longest_homopolymer(seq).alias("hp"), longest_run(seq, "GC").alias("gc"))


def kmer_positions(seq: Column, kmer: str, overlapping: bool = False) -> Column:
    """SQ-07: array of the 1-based positions of a k-mer; from the left, matches that don't overlap, or all of them."""
    last = F.length(seq) - len(kmer) + 1
    all_ = F.when(last > 0, F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(seq, i, F.lit(len(kmer))) == kmer)).otherwise(F.expr("cast(array() AS array<int>)"))
    borders = any(kmer.startswith(kmer[i:]) for i in range(1, len(kmer)))
    if overlapping or not borders:  # it can't overlap itself
        return all_
    apart = lambda taken, i: F.when(F.coalesce(i - F.element_at(taken, -1) >= len(kmer), F.lit(True)), F.concat(taken, F.array(i))).otherwise(taken)
    return F.aggregate(all_, F.expr("cast(array() AS array<int>)"), lambda taken, i: F.when(F.size(taken) == 0, F.array(i)).otherwise(apart(taken, i)))


def kmer_search(seq: Column, kmers: list[str], both_strands: bool = False) -> Column:
    """SQ-07: map of each k-mer to its positions, those of its reverse complement behind them."""
    turned = lambda k: k[::-1].translate(str.maketrans("ACGT", "TGCA"))
    places = lambda k: F.concat(kmer_positions(seq, k), kmer_positions(seq, turned(k))) if both_strands else kmer_positions(seq, k)
    return F.create_map(*(x for k in kmers for x in (F.lit(k), places(k))))


def wrap(seq: Column, width: int = 80) -> Column:
    """SQ-10, SK-13: lines of a FASTA record, joined by line feeds."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


#: fixed values: amino acids of the standard code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(seq: Column) -> Column:
    """SQ-14: amino acids of the whole codons of an upper-case sequence; X where a letter is unknown."""
    place = lambda codon, i: F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) - 1
    index = lambda codon: place(codon, 1) * 16 + place(codon, 2) * 4 + place(codon, 3)
    codons = F.transform(F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3)), lambda i: F.substring(seq, i, F.lit(3)))
    acids = F.transform(codons, lambda c: F.when(c.rlike("^[ACGT]{3}$"), F.substring(F.lit(AMINO), index(c) + 1, F.lit(1))).otherwise("X"))
    return F.when(F.length(seq) >= 3, F.array_join(acids, "")).otherwise("")


def clip_lengths(cigar: Column) -> tuple[Column, Column]:
    """RD-11: soft-clipped bases at the left and at the right end."""
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("long"), F.lit(0))
    return number(r"^(?:\d+H)?(\d+)S"), number(r"[^S\d](\d+)S(?:\d+H)?$")


def cigar_blocks(start: Column, cigar: Column) -> Column:
    """As read_blocks, with deletions (op D, read_start of the base behind) beside aligned blocks (op M)."""
    return _walk(start, cigar, "M=XD")


def read_blocks(start: Column, cigar: Column) -> Column:
    """RD-10: array of (start_, end_, read_start) of a CIGAR's aligned blocks (M, =, X); read_start is 1-based in the read."""
    return F.transform(_walk(start, cigar, "M=X"), lambda b: F.struct(b["start_"].alias("start_"), b["end_"].alias("end_"), b["read_start"].alias("read_start")))


def _walk(start: Column, cigar: Column, kept: str) -> Column:
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    ops = F.arrays_zip(F.transform(F.regexp_extract_all(cigar, pattern, F.lit(1)), lambda x: x.cast("long")).alias("n"), F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("op"))
    none = F.expr("cast(array() AS array<struct<start_: bigint, end_: bigint, read_start: bigint, op: string>>)")
    first = F.struct(start.cast("long").alias("at"), F.lit(1).cast("long").alias("read"), none.alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        block = F.array(F.struct(acc["at"].alias("start_"), (acc["at"] + x["n"] - 1).alias("end_"), acc["read"].alias("read_start"), F.when(x["op"] == "D", "D").otherwise("M").alias("op")))
        moved = lambda c, ops: acc[c] + F.when(x["op"].isin(*ops), x["n"]).otherwise(F.lit(0))
        return F.struct(moved("at", "M=XDN").alias("at"), moved("read", "M=XIS").alias("read"), F.when(x["op"].isin(*kept), F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    return F.aggregate(ops, first, step, lambda acc: acc["blocks"])


def md_mismatches(start: Column, cigar: Column, md: Column, seq: Column, quals: Column | None = None, least_quality: int = 0) -> Column:
    """RD-06 without a reference: array of (offset: 0-based in the read, pos, ref, alt) by the tags MD and CIGAR, in the read's order.

    MD counts aligned bases and names the reference's letter at each mismatch; deleted letters (^) are none of them, nor are
    clips and insertions, which the CIGAR places. quals is an array of int; bases below least_quality are left out."""
    tokens = F.regexp_extract_all(F.upper(md), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    none = F.expr("cast(array() AS array<struct<nth: bigint, ref: string>>)")

    def step(acc: Column, x: Column) -> Column:
        number, deleted = x.rlike(r"^\d"), F.startswith(x, F.lit("^"))
        seen = acc["seen"] + F.when(number, x.try_cast("long")).when(deleted, F.lit(0)).otherwise(F.lit(1))
        found = F.when(number | deleted, acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(acc["seen"].alias("nth"), x.alias("ref")))))
        return F.struct(seen.alias("seen"), found.alias("found"))

    named = F.aggregate(tokens, F.struct(F.lit(0).cast("long").alias("seen"), none.alias("found")), step, lambda acc: acc["found"])
    size = lambda b: b["end_"] - b["start_"] + 1
    empty = F.expr("cast(array() AS array<struct<start_: bigint, read_start: bigint, first: bigint, last: bigint>>)")

    def count(acc: Column, b: Column) -> Column:
        block = F.struct(b["start_"].alias("start_"), b["read_start"].alias("read_start"), acc["n"].alias("first"), (acc["n"] + size(b) - 1).alias("last"))
        return F.struct((acc["n"] + size(b)).alias("n"), F.concat(acc["blocks"], F.array(block)).alias("blocks"))

    # each block with the aligned bases before it; in an array of one, so that it is worked out once for a read
    counted = F.aggregate(read_blocks(start, cigar), F.struct(F.lit(0).cast("long").alias("n"), empty.alias("blocks")), count, lambda acc: acc["blocks"])

    def placed(blocks: Column, m: Column) -> Column:
        inside = F.filter(blocks, lambda c: (c["first"] <= m["nth"]) & (m["nth"] <= c["last"]))
        return F.get(F.transform(inside, lambda x: F.struct((x["read_start"] - 1 + m["nth"] - x["first"]).alias("offset"), (x["start_"] + m["nth"] - x["first"]).alias("pos"), m["ref"].alias("ref"))), 0)

    found = F.get(F.transform(F.array(counted), lambda blocks: F.transform(named, lambda m: placed(blocks, m))), 0)
    out = F.transform(found, lambda x: F.struct(x["offset"].alias("offset"), x["pos"].alias("pos"), x["ref"].alias("ref"), F.substr(seq, (x["offset"] + 1).cast("int"), F.lit(1)).alias("alt")))
    return out if quals is None else F.filter(out, lambda m: F.get(quals, m["offset"].cast("int")) >= least_quality)
