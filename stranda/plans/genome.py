"""Queries of the reference sequence (SC-06, SQ): fetching, windows, spliced and translated sequences, k-mers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import FEAT, GENOME, NEAR, READS
from ..functions import sequence as sq
from ..operators import alignments, amplicons, genome, kmers, transcripts
from .base import WITH, get, query

SIZE = 256  # small chunks, so that small tables have many
# whole chromosomes: N where the fixture has no piece
_WHOLE = WITH + f""", n AS ({NEAR}), pc AS ({GENOME}), en AS (SELECT chrom, max(at_ + length(seq)) AS total FROM pc GROUP BY chrom),
w AS (SELECT chrom, string_agg(coalesce(seq, repeat('N', 32)), '' ORDER BY at_) AS seq FROM (SELECT chrom, unnest(range(0, total, 32)) AS at_ FROM en) x LEFT JOIN pc USING (chrom, at_) GROUP BY chrom) """
_CUT = "repeat('N', greatest(0, least({e}, 0) - {s} + 1)::INT) || rpad(substr(w.seq, greatest({s}, 1)::INT, greatest(0, {e} - greatest({s}, 1) + 1)::INT), greatest(0, {e} - greatest({s}, 1) + 1)::INT, 'N')"


def _genome(spark, sf_dir) -> DataFrame:
    return genome.chunked(get(GENOME)(spark, sf_dir)[0].withColumnRenamed("at_", "at"), SIZE)


@query("seq_fetch", _WHOLE + f"SELECT uid, CASE WHEN e < s THEN '' ELSE {_CUT.format(s='s', e='e')} END AS seq FROM (SELECT uid, chrom, start_ - 40 + CASE WHEN uid % 50 = 0 THEN 10000000 ELSE 0 END AS s, end_ + uid % 3 * 300 + CASE WHEN uid % 50 = 0 THEN 10000000 ELSE 0 END AS e FROM f) q JOIN w USING (chrom)")
def fetch(spark, sf_dir):
    """SQ-13: intervals that may begin before the first base or lie behind the last."""
    far = F.when(F.col("uid") % 50 == 0, 10_000_000).otherwise(0)
    feat = get(FEAT)(spark, sf_dir)[0].withColumns({"start_": F.col("start_") - 40 + far, "end_": F.col("end_") + F.col("uid") % 3 * 300 + far})
    return genome.fetch(feat, _genome(spark, sf_dir), ["uid"], SIZE)


@query("seq_genome_windows", _WHOLE + "SELECT chrom, 1 + k * 25 AS start_, k * 25 + 60 AS end_, rpad(substr(seq, (1 + k * 25)::INT, 60), 60, 'N') AS seq FROM (SELECT chrom, seq, unnest(range(0, 1 + ceil(greatest(0, length(seq) - 60) / 25.0)::BIGINT)) AS k FROM w) x")
def genome_windows(spark, sf_dir):
    """SC-06, SQ-09."""
    return genome.windows(_genome(spark, sf_dir), 60, 25, size=SIZE)


@query("seq_sparse_windows", _WHOLE + "SELECT 'chr2' AS chrom, 301 - 5 + k * 90 AS start_, 305 + k * 90 AS end_, substr(repeat('N', 5) || seq || repeat('N', 30), (1 + k * 90)::INT, 10) AS seq FROM (SELECT substr(seq, 301, 600) AS seq, unnest(range(0, ceil((600 + 10) / 90.0)::BIGINT)) AS k FROM w WHERE chrom = 'chr2') x WHERE k * 90 < length(seq) + 10")
def sparse_windows(spark, sf_dir):
    """SC-06: a region with padding, steps larger than windows."""
    return genome.windows(_genome(spark, sf_dir), 10, 90, padding=True, region=("chr2", 301, 900), size=SIZE)


_PART = _CUT.format(s="start_", e="end_")
_SPLICED = _WHOLE + f", sp AS (SELECT tx_id, CASE WHEN min(strand) = '-' THEN translate(reverse(string_agg(p, '' ORDER BY start_)), 'ACGT', 'TGCA') ELSE string_agg(p, '' ORDER BY start_) END AS seq FROM (SELECT n.*, {_PART} AS p FROM n JOIN w USING (chrom)) x GROUP BY tx_id) "


def _spliced(spark, sf_dir, kept: tuple[str, ...] = ()) -> DataFrame:
    return genome.sequences(get(NEAR)(spark, sf_dir)[0], _genome(spark, sf_dir), ["tx_id"], "spliced", SIZE, kept=kept)


@query("seq_spliced", _SPLICED + "SELECT tx_id, seq FROM sp")
def spliced(spark, sf_dir):
    """SQ-12, SQ-13."""
    return _spliced(spark, sf_dir)


@query("seq_rna", _WHOLE + f"SELECT tx_id, CASE WHEN strand = '-' THEN translate(reverse(p), 'ACGT', 'TGCA') ELSE p END AS seq FROM (SELECT tx_id, strand, {_PART} AS p FROM (SELECT tx_id, min(chrom) AS chrom, min(strand) AS strand, min(start_) AS start_, max(end_) AS end_ FROM n GROUP BY tx_id) t JOIN w USING (chrom)) x")
def rna(spark, sf_dir):
    """SQ-12, unspliced."""
    tx = get(NEAR)(spark, sf_dir)[0].groupBy("tx_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("start_").alias("start_"), F.max("end_").alias("end_"))
    return genome.sequences(tx, _genome(spark, sf_dir), ["tx_id"], "rna", SIZE)


_CODE = sq.AMINO
_AT = "(instr('TCAG', substr(seq, i, 1)) - 1) * 16 + (instr('TCAG', substr(seq, i + 1, 1)) - 1) * 4 + instr('TCAG', substr(seq, i + 2, 1))"


@query("seq_translated", _SPLICED + f"SELECT tx_id, coalesce(string_agg(CASE WHEN contains(substr(seq, i, 3), 'N') THEN 'X' ELSE substr('{_CODE}', ({_AT})::INT, 1) END, '' ORDER BY i), '') AS protein FROM sp LEFT JOIN (SELECT unnest(range(1, 1000, 3)) AS i) n ON i + 2 <= length(seq) GROUP BY tx_id")
def translated(spark, sf_dir):
    """SQ-12, SQ-14."""
    return _spliced(spark, sf_dir).select("tx_id", sq.translate(F.col("seq")).alias("protein"))


@query("seq_splice_sites", _WHOLE + "SELECT substr(seq, a::INT, 2) AS first_two, substr(seq, (b - 1)::INT, 2) AS last_two, count(*) AS n FROM (SELECT chrom, end_ + 1 AS a, lead(start_) OVER (PARTITION BY tx_id ORDER BY start_, rnk) - 1 AS b FROM n) x JOIN w USING (chrom) WHERE a + 3 <= b AND b <= length(seq) GROUP BY ALL")
def splice_sites(spark, sf_dir):
    """SQ-19."""
    found = _genome(spark, sf_dir)
    gap = transcripts.introns(get(NEAR)(spark, sf_dir)[0]).join(genome.lengths(found, SIZE), "chrom").filter("start_ + 3 <= end_ AND end_ <= length")
    ends = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("start_").alias("s")), F.struct(F.lit(2).alias("side"), (F.col("end_") - 1).alias("s"))))
    two = gap.select("tx_id", "n", "chrom", ends.alias("x")).select("tx_id", "n", "chrom", "x.side", F.col("x.s").alias("start_"), (F.col("x.s") + 1).alias("end_"))
    got = genome.fetch(two, found, ["tx_id", "n", "side"], SIZE).groupBy("tx_id", "n").agg(F.max(F.when(F.col("side") == 1, F.col("seq"))).alias("first_two"), F.max(F.when(F.col("side") == 2, F.col("seq"))).alias("last_two"))
    return got.groupBy("first_two", "last_two").agg(F.count("*").alias("n"))


# intervals 120 positions apart on average, so that some meet when extended, and one chromosome that the genome lacks
_TARGET = "SELECT uid, CASE WHEN uid % 90 = 7 THEN 'chrX' ELSE chrom END AS chrom, start_, end_, strand, name, cast(floor(score) AS bigint) AS score FROM f WHERE uid % 30 IN (0, 3, 7, 9)"
_AMPLIFIED = _WHOLE + f""", q AS ({_TARGET}), x AS (SELECT q.*, greatest(1, start_ - 20) AS s, end_ + 20 AS e, name || '_' || chrom || '_' || start_ || '_' || end_ AS label, length(w.seq) AS len, w.seq FROM q JOIN w USING (chrom) WHERE start_ <= end_),
y AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s, e, label, uid ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY chrom ORDER BY s, e, label, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM x) z),
pz AS (SELECT chrom, island, min(s) AS gs, max(e) AS ge, count(*) AS n, any_value(seq) AS seq FROM y GROUP BY chrom, island), pn AS (SELECT chrom, island, string_agg(label, '+' ORDER BY s, e, label) AS amplicon FROM (SELECT DISTINCT chrom, island, s, e, label FROM y) u GROUP BY chrom, island),
am AS (SELECT *, repeat('N', 15) || substr(seq, gs::INT, (ge - gs + 1)::INT) || repeat('N', 15) AS padded FROM pz JOIN pn USING (chrom, island)) """


def _amplicons(spark, sf_dir) -> amplicons.Amplicons:
    feat = get(FEAT)(spark, sf_dir)[0].filter("uid % 30 IN (0, 3, 7, 9)")
    feat = feat.withColumns({"chrom": F.when(F.col("uid") % 90 == 7, "chrX").otherwise(F.col("chrom")), "score": F.floor("score")})
    return amplicons.build(feat, _genome(spark, sf_dir), 15, 20, SIZE)


@query("tl_amplicons", _AMPLIFIED + "SELECT amplicon, chrom, gs::BIGINT AS start_, ge::BIGINT AS end_, n, padded AS seq, length(padded) AS length, md5(padded) AS md5 FROM am")
def amplicon_pieces(spark, sf_dir):
    """TL-04: merged, padded pieces."""
    return _amplicons(spark, sf_dir).pieces


@query("tl_amplicon_files", _AMPLIFIED + """SELECT 'bed' AS file, concat_ws(chr(9), amplicon, 15 + start_ - gs, 16 + end_ - gs, name, score, coalesce(strand, '.')) AS value FROM y JOIN am USING (chrom, island)
UNION ALL SELECT 'gff3', concat_ws(chr(9), amplicon, 'stranda', 'transcript', 16 + start_ - gs, 16 + end_ - gs, score, coalesce(strand, '.'), 0, 'gene_name=' || name) FROM y JOIN am USING (chrom, island)
UNION ALL SELECT 'sizes', amplicon || chr(9) || length(padded) FROM am UNION ALL SELECT 'dict', concat_ws(chr(9), '@SQ', 'SN:' || amplicon, 'LN:' || length(padded), 'M5:' || md5(padded), 'UR:file:amplicons.fa') FROM am
UNION ALL SELECT 'fasta', '>' || amplicon || chr(10) || regexp_replace(padded, '(.{60})', '\\1' || chr(10), 'g') FROM am WHERE length(padded) % 60 <> 0 UNION ALL SELECT 'fasta', '>' || amplicon || chr(10) || rtrim(regexp_replace(padded, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) FROM am WHERE length(padded) % 60 = 0""")
def amplicon_files(spark, sf_dir):
    """TL-04: the lines of all files."""
    made = _amplicons(spark, sf_dir)
    files = {"bed": amplicons.bed_lines(made.mapped), "gff3": amplicons.gff_lines(made.mapped), "sizes": amplicons.size_lines(made.pieces), "dict": amplicons.dict_lines(made.pieces, "file:amplicons.fa"), "fasta": amplicons.fasta_lines(made.pieces, 60)}
    return reduce(DataFrame.unionByName, (lines.select(F.lit(name).alias("file"), "value") for name, lines in files.items()))


@query("tl_amplicon_log", _AMPLIFIED + "SELECT coalesce(sum(n), 0)::BIGINT AS parsed_intervals, count(*) AS written_amplicons, round(sum(n * length(padded)) / count(*), 6) AS mean_amplicon_length FROM am")
def amplicon_log(spark, sf_dir):
    """TL-04: the log."""
    return amplicons.summary(_amplicons(spark, sf_dir)).withColumn("mean_amplicon_length", F.round("mean_amplicon_length", 6))


_SEARCHED = ["ACAC", "AA", "GATTAC", "CCCGGG"]


@query("seq_genome_kmers", _WHOLE.replace("WITH f", "WITH RECURSIVE f", 1) + f""", k0 AS (SELECT unnest({_SEARCHED}) AS kmer), k AS (SELECT kmer, '+' AS strand, kmer AS x FROM k0 UNION ALL SELECT kmer, '-', translate(reverse(kmer), 'ACGT', 'TGCA') FROM k0 WHERE translate(reverse(kmer), 'ACGT', 'TGCA') <> kmer),
h AS (SELECT chrom, kmer, strand, instr(seq, x)::BIGINT AS pos FROM w, k WHERE contains(seq, x) UNION ALL
  SELECT chrom, kmer, strand, pos + length(kmer) - 1 + instr(substr(seq, (pos + length(kmer))::INT), x) FROM h JOIN w USING (chrom) JOIN k USING (kmer, strand) WHERE contains(substr(seq, (pos + length(kmer))::INT), x))
SELECT chrom, kmer, strand, pos FROM h""")
def genome_kmers(spark, sf_dir):
    """SQ-08, on both strands, matches that don't overlap."""
    searched = spark.createDataFrame([(k,) for k in _SEARCHED], "kmer string")
    return kmers.find_positions(_genome(spark, sf_dir), searched, both_strands=True, size=SIZE)


@query("seq_kmer_targets", _SPLICED + ", k AS (SELECT DISTINCT substr(seq, 9, 8) AS kmer FROM r WHERE flag & 3844 = 0), h AS (SELECT DISTINCT kmer, tx_id, gene_id FROM (SELECT tx_id, seq, unnest(range(1, length(seq) - 6)) AS i FROM sp) x JOIN k ON substr(seq, i::INT, 8) = kmer JOIN (SELECT DISTINCT tx_id, gene_id FROM n) g USING (tx_id)) SELECT kmer, tx_id, gene_id, count(DISTINCT gene_id) OVER (PARTITION BY kmer) AS n_genes FROM h")
def kmer_targets(spark, sf_dir):
    """SQ-21: words of reads against spliced transcripts."""
    wanted = get(READS)(spark, sf_dir)[0].filter("(flag & 3844) = 0").select(F.substring("seq", 9, 8).alias("kmer")).distinct()
    tx = _spliced(spark, sf_dir, ("gene_id",)).withColumn("gene_id", F.explode("gene_id"))
    return kmers.targets(wanted, tx)


_HITS = "list_filter(range(1, 30), lambda i: substr(seq, i::INT, 4) = '{}')"


@query("seq_kmer_positions", WITH + f", a AS (SELECT uid, 'ACAC' AS kmer, {_HITS.format('ACAC')} AS p FROM r UNION ALL SELECT uid, 'TTTT', {_HITS.format('TTTT')} FROM r) SELECT uid, kmer, unnest(list_reduce(p, lambda acc, i: CASE WHEN i - acc[-1] >= 4 THEN list_append(acc, i) ELSE acc END, [-9]))::BIGINT AS pos FROM a".replace("SELECT uid, kmer, unnest(", "SELECT uid, kmer, pos FROM (SELECT uid, kmer, unnest(") + ") x WHERE pos > 0")
def kmer_positions(spark, sf_dir):
    """SQ-07."""
    found = get(READS)(spark, sf_dir)[0].select("uid", F.explode(sq.kmer_search(F.col("seq"), ["ACAC", "TTTT"])).alias("kmer", "at"))
    return found.select("uid", "kmer", F.explode("at").alias("pos")).withColumn("pos", F.col("pos").cast("long"))


_BLOCK = "CASE cigar WHEN '32M' THEN [[0, 31]] WHEN '12M10N20M' THEN [[0, 11], [22, 41]] WHEN '6S26M' THEN [[0, 25]] WHEN '16M2D16M' THEN [[0, 15], [18, 33]] ELSE [[0, 9], [10, 29]] END"


@query("sk_built_reads", _WHOLE + f""", k AS (SELECT uid, chrom, start_ + x[1] AS start_, start_ + x[2] AS end_ FROM (SELECT uid, chrom, start_, unnest({_BLOCK}) AS x FROM r) y),
  q AS (SELECT uid, string_agg(p, '' ORDER BY start_) AS seq FROM (SELECT k.*, {_PART} AS p FROM k JOIN w USING (chrom)) z GROUP BY uid)
  SELECT 'r' || uid AS name, (flag & 16)::INT AS flag, chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, CASE cigar WHEN '6S26M' THEN '26M' WHEN '16M2D16M' THEN '16M2N16M' WHEN '10M2I20M' THEN '10M0N20M' ELSE cigar END AS cigar,
  CASE WHEN uid % 2 = 0 THEN q.seq ELSE substr(q.seq, 1, (uid % 7)::INT) || 'T' || substr(q.seq, (uid % 7)::INT + 2) END AS seq, repeat('~', length(q.seq)) AS qual FROM r JOIN q USING (uid)""")
def built_reads(spark, sf_dir):
    """SK-14: reads of blocks, with the genome's bases and a substitution in every other one."""
    reads = get(READS)(spark, sf_dir)[0]
    change = F.when(F.col("uid") % 2 == 1, F.array(F.struct((F.col("uid") % 7).cast("int").alias("off"), F.lit("T").alias("alt"))))
    given = reads.select(F.concat(F.lit("r"), F.col("uid")).alias("name"), "chrom", F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"), sq.read_blocks(F.col("start_"), F.col("cigar")).alias("blocks"), change.alias("mm"))
    return alignments.built(given, _genome(spark, sf_dir), SIZE).select("name", "flag", "chrom", F.col("start_").cast("long").alias("start_"), F.col("end_").cast("long").alias("end_"), "cigar", "seq", "qual")
