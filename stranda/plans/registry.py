"""Named queries over the fixtures, each with the SQL that gives the same rows. Names begin with the operators' group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import EXON, FEAT, GENE, IV, READS, SIGNAL, VAR
from ..functions import interval as iv
from ..functions import sequence as sq
from ..operators import islands, joins, transcripts
from ..operators import reads as reads_ops
from . import genome, intervals, reads, transcriptome  # noqa: F401  (they register their queries)
from .base import ALL as _ALL
from .base import OVER as _OVER
from .base import WITH as _WITH
from .base import get as _get
from .base import query as _query

_CENTS = "cast(round({}.score * 100) AS bigint)"


@_query("ij_weighted_score", _WITH + f"SELECT f.uid, count(i.l_orderkey) AS n, cast(coalesce(sum({_CENTS.format('i')} * (least(f.end_, i.end_) - greatest(f.start_, i.start_) + 1)), 0) AS bigint) AS sc FROM f LEFT JOIN i ON {_OVER} GROUP BY f.uid")
def weighted_score(spark, sf_dir):
    """IJ-01, IJ-21: overlapping intervals of each reference interval, and their score by shared positions, in cents."""
    feat, ivs = _get(FEAT, IV)(spark, sf_dir)
    cents = F.round(F.col("r_score") * 100).cast("long") * joins.overlap_length()
    out = joins.annotate(feat.select("uid", "chrom", "start_", "end_"), ivs, ["uid"], F.count("*").alias("n"), F.sum(cents).alias("sc"))
    return out.select("uid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sc", F.lit(0)).cast("long").alias("sc"))


@_query("ij_overlap_inner", _WITH + f"SELECT f.uid, i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, cast(least(f.end_, i.end_) - greatest(f.start_, i.start_) + 1 AS bigint) AS overlap FROM f JOIN i ON {_OVER}")
def overlap_inner(spark, sf_dir):
    """IJ-02."""
    feat, ivs = _get(FEAT, IV)(spark, sf_dir)
    pairs = joins.overlap_pairs(feat.select("uid", "chrom", "start_", "end_"), ivs)
    return pairs.select("uid", *(F.col(f"r_{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), joins.overlap_length().cast("long").alias("overlap"))


@_query("ij_overlap_stranded", _WITH + f"SELECT f.uid, count(*) AS n FROM f JOIN i ON {_OVER} AND f.strand IS NOT DISTINCT FROM i.strand GROUP BY f.uid")
def overlap_stranded(spark, sf_dir):
    """IJ-02 on one strand."""
    feat, ivs = _get(FEAT, IV)(spark, sf_dir)
    return joins.overlap_pairs(feat, ivs, stranded=True).groupBy("uid").agg(F.count("*").alias("n"))


@_query("ij_window_join", _WITH + "SELECT f.uid, count(*) AS n FROM f JOIN i ON f.chrom = i.chrom AND f.start_ - 50 <= i.end_ AND i.start_ <= f.end_ + 50 AND f.start_ <= f.end_ GROUP BY f.uid")
def window_join(spark, sf_dir):
    """IJ-05."""
    feat, ivs = _get(FEAT, IV)(spark, sf_dir)
    return joins.overlap_pairs(feat, ivs, within=50).groupBy("uid").agg(F.count("*").alias("n"))


@_query("ij_semi", _WITH + f"SELECT f.uid FROM f WHERE EXISTS (SELECT 1 FROM i WHERE {_OVER})")
def semi(spark, sf_dir):
    """IJ-04."""
    feat, ivs = _get(FEAT, IV)(spark, sf_dir)
    return joins.matched(feat, ivs, "left_semi", ["uid"]).select("uid")


@_query("ij_anti", _WITH + "SELECT g.gene_id FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.chrom = g.chrom AND f.start_ <= g.end_ AND g.start_ <= f.end_ AND f.start_ <= f.end_)")
def anti(spark, sf_dir):
    """IJ-03."""
    gene, feat = _get(GENE, FEAT)(spark, sf_dir)
    return joins.matched(gene, feat, "left_anti", ["gene_id"], bin_size=4096).select("gene_id")


_MERGE = "SELECT {0}, cast(min(start_) AS bigint) AS start_, cast(max(end_) AS bigint) AS end_, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY {0} ORDER BY start_, end_, id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_ > coalesce(max(end_) OVER (PARTITION BY {0} ORDER BY start_, end_, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {1}, -1) THEN 1 ELSE 0 END AS new FROM {2}) a) b GROUP BY {0}, island"


@_query("ij_merge", _WITH + _MERGE.format("chrom", 0, "(SELECT *, uid AS id FROM f)"))
def merge(spark, sf_dir):
    """IJ-06."""
    return islands.merge(_get(FEAT)(spark, sf_dir)[0], ["chrom"], tile=1000)


@_query("ij_merge_adjacent", _WITH + _MERGE.format("chrom", 1, "(SELECT *, l_orderkey AS id FROM i)"))
def merge_adjacent(spark, sf_dir):
    """IJ-06, joining what touches."""
    return islands.merge(_get(IV)(spark, sf_dir)[0], ["chrom"], adjacent=True, tile=500)


@_query("ij_merge_stranded", _WITH + _MERGE.format("chrom, strand", 0, "(SELECT *, uid AS id FROM f)"))
def merge_stranded(spark, sf_dir):
    """IJ-06, each strand for itself."""
    return islands.merge(_get(FEAT)(spark, sf_dir)[0], ["chrom", "strand"], tile=1000)


@_query("ij_compact", _WITH + "SELECT chrom, min(start_) AS start_, max(end_) AS end_, min(value) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start_ ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(end_) OVER w + 1 = start_ AND lag(value) OVER w = value THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY chrom ORDER BY start_)) a) b GROUP BY chrom, run")
def compact(spark, sf_dir):
    """IJ-20."""
    return islands.compact(_get(SIGNAL)(spark, sf_dir)[0], tile=1000)


@_query("ij_tile_counts", _WITH + "SELECT chrom, tile, count(*) AS n FROM (SELECT chrom, unnest(range(cast(floor((start_ - 1) / 100.0) AS bigint), cast(floor((end_ - 1) / 100.0) AS bigint) + 1)) AS tile FROM i) x GROUP BY chrom, tile")
def tile_counts(spark, sf_dir):
    """IJ-10, IJ-11."""
    return islands.tile_counts(_get(IV)(spark, sf_dir)[0], 100)


@_query("ij_gene_triples", _WITH + "SELECT gene_id, lag(gene_id) OVER w AS prev_id, lead(gene_id) OVER w AS next_id FROM g WINDOW w AS (ORDER BY chrom, start_, end_, gene_id)")
def gene_triples(spark, sf_dir):
    """IJ-19."""
    return islands.neighbours(_get(GENE)(spark, sf_dir)[0], "gene_id").toDF("gene_id", "prev_id", "next_id")


_GAP = "greatest(0, start_ - {0}.end_, {0}.start_ - end_) <= 3000"


@_query("ij_gene_triples_near", _WITH + f"SELECT gene_id, CASE WHEN p.chrom = chrom AND {_GAP.format('p')} THEN p.gene_id END AS prev_id, CASE WHEN q.chrom = chrom AND {_GAP.format('q')} THEN q.gene_id END AS next_id FROM (SELECT *, lag(g) OVER w AS p, lead(g) OVER w AS q FROM g WINDOW w AS (ORDER BY chrom DESC, start_, end_, gene_id)) x")
def gene_triples_near(spark, sf_dir):
    """IJ-19 within a distance, chromosomes in an order of their own."""
    found = islands.neighbours(_get(GENE)(spark, sf_dir)[0], "gene_id", [f"chr{i}" for i in range(5, 0, -1)], max_dist=3000, tile=10_000)
    return found.toDF("gene_id", "prev_id", "next_id")


@_query("iv_predicates", _WITH + "SELECT f.uid, i.l_orderkey, i.l_linenumber, i.l_suppkey, i.l_partkey, f.start_ <= f.end_ AND f.start_ <= i.end_ AND i.start_ <= f.end_ AS overlaps, f.start_ <= i.start_ AND f.end_ >= i.end_ AS envelops, f.end_ + 1 = i.start_ OR i.end_ + 1 = f.start_ AS adjacent, cast(CASE WHEN f.start_ <= f.end_ AND f.start_ <= i.end_ AND i.start_ <= f.end_ THEN 0 WHEN i.start_ > f.end_ THEN i.start_ - f.end_ ELSE i.end_ - f.start_ END AS bigint) AS distance FROM f JOIN i ON f.uid = i.l_partkey AND f.chrom = i.chrom")
def predicates(spark, sf_dir):
    """IV-10, IV-11, IV-15, IV-19 on intervals that share a key."""
    feat, ivs = _get(FEAT, IV)(spark, sf_dir)
    both = feat.join(ivs.withColumnsRenamed({c: f"{c}b" for c in ("chrom", "start_", "end_", "strand")}), (F.col("uid") == F.col("l_partkey")) & (F.col("chrom") == F.col("chromb")))
    a, b = iv.Interval.of(), iv.Interval.of(suffix="b")
    return both.select("uid", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", iv.overlaps(a, b).alias("overlaps"), iv.envelops(a, b).alias("envelops"), iv.is_adjacent(a, b).alias("adjacent"), iv.distance(a, b).alias("distance"))


@_query("iv_flanks", _WITH + "SELECT tx_id, rnk, start_, cast(CASE strand WHEN '+' THEN start_ - 30 WHEN '-' THEN end_ + 1 END AS bigint) AS up_start, cast(CASE strand WHEN '+' THEN end_ + 30 WHEN '-' THEN start_ - 1 END AS bigint) AS down_end, start_ - 5 AS ext_start FROM e")
def flanks(spark, sf_dir):
    """IV-16, IV-17."""
    a = iv.Interval.of()
    return _get(EXON)(spark, sf_dir)[0].select("tx_id", "rnk", "start_", iv.upstream(a, 30)[0].cast("long").alias("up_start"), iv.downstream(a, 30)[1].cast("long").alias("down_end"), iv.extended(a, 5)[0].alias("ext_start"))


@_query("tx_introns", _WITH + "SELECT * FROM (SELECT tx_id, cast(row_number() OVER (PARTITION BY tx_id ORDER BY start_) AS bigint) AS n, start_, end_ FROM (SELECT tx_id, end_ + 1 AS start_, lead(start_) OVER (PARTITION BY tx_id ORDER BY start_, rnk) - 1 AS end_ FROM e) a WHERE start_ <= end_) b")
def introns(spark, sf_dir):
    """TX-07: empty introns are left out and not numbered."""
    return transcripts.introns(_get(EXON)(spark, sf_dir)[0]).select("tx_id", "n", "start_", "end_")


@_query("tx_genes", _WITH + "SELECT gene_id, chrom, cast(start_ AS bigint) AS start_, cast(end_ AS bigint) AS end_, strand FROM g")
def genes(spark, sf_dir):
    """TX-03: gene hulls."""
    return _get(EXON)(spark, sf_dir)[0].groupBy("gene_id").agg(F.min("chrom").alias("chrom"), F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.min("strand").alias("strand"))


@_query("tx_ranks", _WITH + "SELECT tx_id, rnk, cast(row_number() OVER (PARTITION BY tx_id ORDER BY CASE WHEN strand = '-' THEN -start_ ELSE start_ END, rnk) AS bigint) AS rank5 FROM e")
def ranks(spark, sf_dir):
    """TX-08: rank from the 5' end."""
    w = Window.partitionBy("tx_id").orderBy(F.when(F.col("strand") == "-", -F.col("start_")).otherwise(F.col("start_")), "rnk")
    return _get(EXON)(spark, sf_dir)[0].select("tx_id", "rnk", F.row_number().over(w).cast("long").alias("rank5"))


@_query("rd_filter_stats", _WITH + "SELECT chrom, CASE WHEN flag & 3844 <> 0 THEN 'flag' WHEN mapq < 10 THEN 'mapq' WHEN end_ - start_ + 1 > 40 THEN 'span' ELSE 'kept' END AS label, count(*) AS n FROM r GROUP BY ALL")
def filter_stats(spark, sf_dir):
    """RD-01, RD-02, RD-04, RD-05: the first filter that drops a read."""
    label = F.when(F.col("flag").bitwiseAND(F.lit(3844)) != 0, "flag").when(F.col("mapq") < 10, "mapq").when(F.col("end_") - F.col("start_") + 1 > 40, "span").otherwise("kept")
    return _get(READS)(spark, sf_dir)[0].groupBy("chrom", label.alias("label")).agg(F.count("*").alias("n"))


_BLOCKS = "SELECT *, unnest(CASE cigar WHEN '32M' THEN [[0, 31, 1]] WHEN '12M10N20M' THEN [[0, 11, 1], [22, 41, 13]] WHEN '6S26M' THEN [[0, 25, 7]] WHEN '16M2D16M' THEN [[0, 15, 1], [18, 33, 17]] ELSE [[0, 9, 1], [10, 29, 13]] END) AS b FROM r WHERE flag & 3844 = 0"


@_query("rd_depth", _WITH + f"SELECT chrom, pos, count(*) AS depth FROM (SELECT chrom, unnest(range(start_ + b[1], start_ + b[2] + 1)) AS pos FROM ({_BLOCKS}) x) y GROUP BY chrom, pos")
def depth(spark, sf_dir):
    """RD-10: coverage of positions by aligned blocks."""
    reads = _get(READS)(spark, sf_dir)[0].filter(F.col("flag").bitwiseAND(F.lit(3844)) == 0)
    blocks = reads.select("chrom", F.explode(sq.read_blocks(F.col("start_"), F.col("cigar"))).alias("b")).select("chrom", "b.start_", "b.end_")
    return islands.depth(blocks).select("chrom", F.explode(F.sequence("start_", "end_")).alias("pos"), "depth")


@_query("rd_pairs", _WITH + "SELECT name, chrom, cast(min(start_) AS bigint) AS start_, cast(max(end_) AS bigint) AS end_, count(*) AS n FROM r WHERE flag & 3844 = 0 GROUP BY name, chrom")
def pairs(spark, sf_dir):
    """RD-08: hulls of mates; orphans are kept."""
    reads = _get(READS)(spark, sf_dir)[0].filter(F.col("flag").bitwiseAND(F.lit(3844)) == 0)
    return reads.groupBy("name", "chrom").agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.count("*").alias("n"))


@_query("seq_functions", _WITH + "SELECT uid, translate(reverse(seq), 'ACGT', 'TGCA') AS rc, length(regexp_replace(seq, '[^GC]', '', 'g'))::BIGINT AS gc, coalesce(list_max(list_transform(regexp_extract_all(seq, '[GC]+'), lambda x: length(x))), 0)::BIGINT AS longest_gc, ((length(seq) - length(replace(seq, 'ACG', ''))) / 3)::BIGINT AS n_acg FROM r")
def seq_functions(spark, sf_dir):
    """SQ-01, SQ-03, SQ-06, SQ-07."""
    s = F.col("seq")
    return _get(READS)(spark, sf_dir)[0].select("uid", sq.reverse_complement(s).alias("rc"), sq.gc_count(s).alias("gc"), sq.longest_run(s, "GC").alias("longest_gc"), sq.kmer_count(s, "ACG").alias("n_acg"))


@_query("vc_zygosity", _WITH + "SELECT gt, CASE WHEN gt = './.' THEN 0 WHEN gt IN ('0/1', '1|0', '1/2') THEN 1 ELSE 2 END AS zyg, CASE WHEN gt IN ('./.', '0/0') THEN 0 ELSE 1 END AS called, count(*) AS n FROM v GROUP BY gt")
def zygosity(spark, sf_dir):
    """VC-01."""
    return _get(VAR)(spark, sf_dir)[0].select("gt", sq.zygosity(F.col("gt")).alias("z")).groupBy("gt", F.col("z.zyg").alias("zyg"), F.col("z.called").alias("called")).agg(F.count("*").alias("n"))


@_query("ag_mean_len", _WITH + "SELECT count(*) AS n, cast(sum(end_ - start_ + 1) AS bigint) AS total FROM i")
def mean_len(spark, sf_dir):
    """AG-01, as sum and count."""
    return _get(IV)(spark, sf_dir)[0].agg(F.count("*").alias("n"), F.sum(F.col("end_") - F.col("start_") + 1).alias("total"))


@_query("ag_mean_by_chrom", _WITH + "SELECT chrom, round(avg(value), 6) AS mean FROM s GROUP BY chrom")
def mean_by_chrom(spark, sf_dir):
    """AG-02."""
    return _get(SIGNAL)(spark, sf_dir)[0].groupBy("chrom").agg(F.round(F.avg("value"), 6).alias("mean"))


@_query("ag_filter_len", _WITH + "SELECT uid, name FROM f WHERE end_ - start_ + 1 > 5")
def filter_len(spark, sf_dir):
    """AG-03."""
    return _get(FEAT)(spark, sf_dir)[0].filter("end_ - start_ + 1 > 5").select("uid", "name")


@_query("ag_type_counts", _WITH + "SELECT name, count(*) AS n FROM f WHERE chrom = 'chr2' AND strand = '-' GROUP BY name")
def type_counts(spark, sf_dir):
    """AG-04."""
    return _get(FEAT)(spark, sf_dir)[0].filter("chrom = 'chr2' AND strand = '-'").groupBy("name").agg(F.count("*").alias("n"))


@_query("seq_3end", _WITH + "SELECT tx_id, start_, end_ FROM (SELECT tx_id, CASE WHEN strand = '-' THEN start_ ELSE end_ - least(size, 40 - after) + 1 END AS start_, CASE WHEN strand = '-' THEN start_ + least(size, 40 - after) - 1 ELSE end_ END AS end_, after FROM (SELECT *, end_ - start_ + 1 AS size, cast(coalesce(sum(end_ - start_ + 1) OVER (PARTITION BY tx_id ORDER BY CASE WHEN strand = '-' THEN start_ ELSE -end_ END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS after FROM e) a) b WHERE after < 40")
def last_bases(spark, sf_dir):
    """SQ-18."""
    return transcripts.last_bases(_get(EXON)(spark, sf_dir)[0], 40).select("tx_id", "start_", "end_")


@_query("seq_rel_coord", _WITH + "SELECT tx_id, rnk, start_, CASE WHEN strand = '-' THEN before + end_ - start_ + 1 ELSE before + 1 END AS rel FROM (SELECT *, cast(coalesce(sum(end_ - start_ + 1) OVER (PARTITION BY tx_id ORDER BY CASE WHEN strand = '-' THEN -end_ ELSE start_ END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before FROM e) a")
def rel_coord(spark, sf_dir):
    """SQ-15 for the first base of each exon."""
    exon = _get(EXON)(spark, sf_dir)[0]
    points = exon.select("tx_id", F.col("start_").alias("pos")).distinct()
    rel = transcripts.to_spliced(exon, points).withColumnRenamed("pos", "start_")
    return exon.select("tx_id", "rnk", "start_").join(rel, ["tx_id", "start_"]).select("tx_id", "rnk", "start_", "rel")


@_query("tx_to_bed12", _WITH + "SELECT tx_id, concat_ws(chr(9), min(chrom), (min(start_) - 1)::VARCHAR, max(end_)::VARCHAR, tx_id::VARCHAR, '0', coalesce(min(strand), '.'), (min(start_) - 1)::VARCHAR, max(end_)::VARCHAR, '0,0,0', count(*)::VARCHAR, string_agg((end_ - start_ + 1)::VARCHAR, ',' ORDER BY start_, end_) || ',', string_agg((start_ - s)::VARCHAR, ',' ORDER BY start_, end_) || ',') AS line FROM (SELECT *, min(start_) OVER (PARTITION BY tx_id) AS s FROM e) a GROUP BY tx_id")
def to_bed12(spark, sf_dir):
    """SK-06."""
    return transcripts.bed12(_get(EXON)(spark, sf_dir)[0])


@_query("rd_pileup", _WITH + f"SELECT chrom, pos, base, count(*) AS n FROM (SELECT chrom, start_ + b[1] + k AS pos, substr(seq, (b[3] + k)::INT, 1) AS base FROM (SELECT *, unnest(range(0, b[2] - b[1] + 1)) AS k FROM ({_BLOCKS}) x) y) z GROUP BY chrom, pos, base")
def pileup(spark, sf_dir):
    """RD-10: counts of bases by position."""
    reads = _get(READS)(spark, sf_dir)[0].filter(F.col("flag").bitwiseAND(F.lit(3844)) == 0)
    bases = reads.select("chrom", "seq", F.explode(sq.read_blocks(F.col("start_"), F.col("cigar"))).alias("b"))
    each = bases.select("chrom", "seq", "b.start_", "b.read_start", F.posexplode(F.sequence("b.start_", "b.end_")).alias("k", "pos"))
    return each.groupBy("chrom", "pos", F.substring("seq", F.col("read_start") + F.col("k"), F.lit(1)).alias("base")).agg(F.count("*").alias("n"))


@_query("rd_downsample", _WITH + "SELECT uid, chrom FROM r QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY md5(uid::VARCHAR), uid) <= 50")
def downsample(spark, sf_dir):
    """RD-13: at most 50 reads of each chromosome, by a hash."""
    return reads_ops.downsample(_get(READS)(spark, sf_dir)[0], "uid", ["chrom"], 50).select("uid", "chrom")


@_query("tx_counts", _WITH + "SELECT gene_id, count(DISTINCT tx_id) AS n_tx, count(*) AS n_exons FROM e GROUP BY gene_id")
def tx_counts(spark, sf_dir):
    """AG-13, TX-23."""
    return _get(EXON)(spark, sf_dir)[0].groupBy("gene_id").agg(F.countDistinct("tx_id").alias("n_tx"), F.count("*").alias("n_exons"))


@_query("ag_norm_max", _WITH + "SELECT uid, round(score / max(score) OVER (PARTITION BY chrom), 6) AS share FROM f")
def norm_max(spark, sf_dir):
    """AG-08: the maxima, a row for each group, are joined back, so that no group is one task."""
    feat = _get(FEAT)(spark, sf_dir)[0]
    most = feat.groupBy("chrom").agg(F.max("score").alias("most"))
    return feat.join(most, "chrom").select("uid", F.round(F.col("score") / F.col("most"), 6).alias("share"))


@_query("ag_collapse", _WITH + "SELECT chrom, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM f GROUP BY chrom")
def collapse(spark, sf_dir):
    """AG-10."""
    return _get(FEAT)(spark, sf_dir)[0].groupBy("chrom").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracles() -> dict:
    return {k: sql for k, (_, sql) in _ALL.items()}
