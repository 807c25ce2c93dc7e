"""Queries of reads (RD), conversions (TL), variants (VC) and of the text formats they come in (SC, SK)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import EXON, FEAT, READS, SIGNAL, VAR
from ..functions import interval as iv
from ..functions import sequence as sq
from ..operators import joins, mates
from ..operators import reads as ops
from ..sources import text
from .base import WITH, get, query

_GOOD = "(flag & 3844) = 0"
_HEX = "0123456789abcdef"


def _reference(pos):
    return F.substring(F.lit("ACGT"), (pos * 7 % 4 + 1).cast("int"), F.lit(1))


def _reads(spark, sf_dir) -> DataFrame:
    """Good reads with base qualities."""
    quals = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: ((F.instr(F.lit(_HEX), F.substring("qualhex", i, F.lit(1))) - 1) * 2 + 5).cast("int"))
    return get(READS)(spark, sf_dir)[0].filter(_GOOD).withColumn("quals", quals)


_OPS = "CASE cigar WHEN '32M' THEN [[0, 31, 1, 0]] WHEN '12M10N20M' THEN [[0, 11, 1, 0], [22, 41, 13, 0]] WHEN '6S26M' THEN [[0, 25, 7, 0]] WHEN '16M2D16M' THEN [[0, 15, 1, 0], [16, 17, 17, 1], [18, 33, 17, 0]] ELSE [[0, 9, 1, 0], [10, 29, 13, 0]] END"
_BASES = f"""SELECT *, substr('ACGT', (pos * 7 % 4)::INT + 1, 1) AS ref, CASE WHEN d = 1 THEN '-' ELSE substr(seq, rp, 1) END AS alt, CASE WHEN d = 0 THEN (instr('{_HEX}', substr(qualhex, rp, 1)) - 1) * 2 + 5 END AS quality
FROM (SELECT *, start_ + b[1] + k AS pos, (b[3] + k)::INT AS rp, b[4] AS d FROM (SELECT *, unnest(range(0, b[2] - b[1] + 1)) AS k FROM (SELECT *, unnest({_OPS}) AS b FROM r WHERE flag & 3844 = 0) x) y) z"""
_BASED = WITH + f", b AS (SELECT * FROM ({_BASES}) q WHERE quality IS NULL OR quality >= 20) "


def _bases(spark, sf_dir) -> DataFrame:
    return ops.bases(_reads(spark, sf_dir), _reference, 20)


@query("rd_pileup_quality", _BASED + "SELECT chrom, pos, ref, alt, count(*) AS n, count(*) FILTER (flag & 16 <> 0) AS n_reverse FROM b GROUP BY chrom, pos, ref, alt")
def pileup(spark, sf_dir):
    """RD-10 by base quality, with deletions and strands."""
    return _bases(spark, sf_dir).groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"), F.count_if(F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("n_reverse"))


@query("rd_mismatches", _BASED + "SELECT uid, count(*) FILTER (alt NOT IN (ref, '-')) AS mismatches, count(*) FILTER (alt = '-') AS deleted FROM b GROUP BY uid")
def mismatches(spark, sf_dir):
    """RD-06."""
    off = ~F.col("alt").isin("-") & (F.col("alt") != F.col("ref"))
    return _bases(spark, sf_dir).groupBy("uid").agg(F.count_if(off).alias("mismatches"), F.count_if(F.col("alt") == "-").alias("deleted"))


@query("rd_mismatch_profile", _BASED + "SELECT ref, alt, strand, n, round(n / sum(n) OVER (PARTITION BY ref, strand), 6) AS prob FROM (SELECT ref, alt, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM b WHERE alt <> '-' GROUP BY ALL) x")
def mismatch_profile(spark, sf_dir):
    """RD-16."""
    found = _bases(spark, sf_dir).withColumn("strand", F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+"))
    return ops.mismatch_profile(found).withColumn("prob", F.round("prob", 6))


_STRAND = "CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END"
_COLUMNS = _BASED + f""", k AS (SELECT *, CASE WHEN total <= 2 THEN 'lowcov' WHEN off / total > 0.7 THEN 'snp' ELSE 'analysed' END AS kind FROM (SELECT chrom, pos, count(*) AS total, count(*) FILTER (alt <> ref) AS off FROM b GROUP BY chrom, pos) x),
cl AS (SELECT uid, pos, f.chrom, kind FROM f JOIN k ON f.chrom = k.chrom AND k.pos BETWEEN f.start_ AND f.end_), d AS (SELECT cl.uid, ref, alt, {_STRAND} AS strand FROM cl JOIN b USING (chrom, pos) WHERE kind = 'analysed' AND alt <> '-') """


def _profiles(spark, sf_dir) -> DataFrame:
    found = _bases(spark, sf_dir).withColumn("strand", F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+"))
    return ops.region_profiles(found, get(FEAT)(spark, sf_dir)[0], "uid", 2, 0.7)


@query("rd_region_columns", _COLUMNS + "SELECT uid, kind, count(*) AS columns FROM cl GROUP BY uid, kind")
def region_columns(spark, sf_dir):
    """RD-17: columns of too low coverage, like SNPs, and analysed ones, of each region."""
    return _profiles(spark, sf_dir).groupBy("uid", "kind").agg(F.sum("columns").alias("columns"))


@query("rd_region_profile", _COLUMNS + """, o AS (SELECT uid, coalesce(sum(off) OVER (ORDER BY md5(uid::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT uid, count(*) FILTER (alt <> ref) AS off FROM d GROUP BY uid) x)
SELECT ref, alt, strand, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ref, strand), 6) AS prob FROM d JOIN o USING (uid) WHERE before < 400 GROUP BY ref, alt, strand""")
def region_profile(spark, sf_dir):
    """RD-16, RD-17, TL-05: regions in a fixed order of chance, until 400 mismatches are counted."""
    return ops.profile_counts(ops.sampled_regions(_profiles(spark, sf_dir), "uid", 400)).withColumn("prob", F.round("prob", 6))


@query("rd_mismatch_rates", _COLUMNS + "SELECT strand, count(*) AS n, count(*) FILTER (alt <> ref) AS mismatches, round(count(*) FILTER (alt <> ref) / count(*), 6) AS prob FROM d GROUP BY strand")
def mismatch_rates(spark, sf_dir):
    """RD-16."""
    return ops.mismatch_rates(ops.profile_counts(_profiles(spark, sf_dir))).withColumn("prob", F.round("prob", 6))


@query("rd_pileup_positions", _BASED + "SELECT chrom, pos, sum(n)::BIGINT AS total, coalesce(string_agg(alt || n, ',' ORDER BY alt), '') AS counts FROM (SELECT v.chrom, v.pos, alt, count(alt) AS n FROM (SELECT DISTINCT chrom, pos FROM v) v LEFT JOIN b ON b.chrom = v.chrom AND b.pos = v.pos GROUP BY ALL) x GROUP BY chrom, pos")
def pileup_positions(spark, sf_dir):
    """RD-10 at listed positions, covered or not."""
    found = ops.pileup_at(_bases(spark, sf_dir), get(VAR)(spark, sf_dir)[0])
    return found.withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda c: F.concat(c["key"], c["value"].cast("string"))), ","))


@query("rd_tag_filter", WITH + "SELECT chrom, CASE WHEN flag & 3844 <> 0 THEN 'flag' WHEN nh IN (2, 3) THEN 'tag' ELSE 'kept' END AS label, count(*) AS n FROM r GROUP BY ALL")
def tag_filter(spark, sf_dir):
    """RD-03, RD-05, UD-06."""
    label = F.when(~F.expr(_GOOD), "flag").when(ops.tag_label(F.col("nh"), [2, 3]), "tag").otherwise("kept")
    return get(READS)(spark, sf_dir)[0].groupBy("chrom", label.alias("label")).agg(F.count("*").alias("n"))


# reads with few different starts and sequences, and some mates elsewhere
_COPIED = "SELECT uid, name, CASE WHEN uid % 18 = 1 THEN 'chr9' ELSE chrom END AS chrom, cast(floor(start_ / 400.0) AS bigint) * 400 AS start_, end_ + 400 AS end_, flag, CASE WHEN uid % 4 < 2 THEN 'ACGT' WHEN uid % 4 = 2 THEN '*' ELSE substr(seq, 1, 2) END AS seq FROM r WHERE uid % 23 <> 0"
_MATED = WITH + f""", c AS ({_COPIED}), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chrom, start_, uid) AS k, count(*) OVER (PARTITION BY name) AS n FROM c),
m AS (SELECT name, CASE WHEN max(n) = 1 THEN 'orphan' WHEN min(chrom) <> max(chrom) THEN 'discordant' ELSE 'pair' END AS kind, min(chrom) AS chrom, min(start_) AS start_, max(end_) AS end_, CASE WHEN min(flag) FILTER (k = 1) & 16 <> 0 THEN '-' ELSE '+' END AS strand,
  min(uid) FILTER (flag & 128 = 0) AS r1, min(uid) FILTER (flag & 128 <> 0) AS r2, coalesce(nullif(min(seq) FILTER (flag & 128 = 0), '*'), '') AS s1, coalesce(nullif(min(seq) FILTER (flag & 128 <> 0), '*'), '') AS s2, min(start_) FILTER (k = 1) AS at_start, min(uid) FILTER (k = 1) AS at_uid FROM o GROUP BY name) """


def _mated(spark, sf_dir) -> DataFrame:
    r = get(READS)(spark, sf_dir)[0].filter("uid % 23 <> 0")
    seq = F.when(F.col("uid") % 4 < 2, "ACGT").when(F.col("uid") % 4 == 2, "*").otherwise(F.substring("seq", 1, 2))
    few = r.select("uid", "name", F.when(F.col("uid") % 18 == 1, "chr9").otherwise(F.col("chrom")).alias("chrom"), (F.floor(F.col("start_") / 400) * 400).alias("start_"), (F.col("end_") + 400).alias("end_"), "flag", seq.alias("seq"))
    return mates.pairs(few, ["chrom", "start_", "uid"])


@query("rd_mates", _MATED + "SELECT name, kind, CASE WHEN kind <> 'discordant' THEN chrom END AS chrom, CASE WHEN kind <> 'discordant' THEN start_ END AS start_, CASE WHEN kind <> 'discordant' THEN end_ END AS end_, CASE WHEN kind <> 'discordant' THEN strand END AS strand, r1, r2 FROM m")
def mated(spark, sf_dir):
    """RD-08: pairs, orphans and discordant mates."""
    return _mated(spark, sf_dir).select("name", "kind", "chrom", "start_", "end_", "strand", F.col("r1.uid").alias("r1"), F.col("r2.uid").alias("r2"))


@query("rd_mates_deduplicated", _MATED + "SELECT name FROM m WHERE kind = 'discordant' OR s1 || s2 = '' UNION ALL SELECT arg_min(name, at_uid + 1e9 * at_start) FROM m WHERE kind <> 'discordant' AND s1 || s2 <> '' GROUP BY chrom, start_, s1, s2")
def mates_deduplicated(spark, sf_dir):
    """RD-09 of pairs."""
    return mates.without_duplicates(_mated(spark, sf_dir)).select("name")


@query("rd_deduplicated", WITH + f", c AS ({_COPIED}) SELECT min(uid) AS uid, chrom, start_, seq FROM c GROUP BY chrom, start_, seq")
def deduplicated(spark, sf_dir):
    """RD-09 of single reads: by place and sequence."""
    reads = _mated(spark, sf_dir).select(F.explode(F.array_compact(F.array("r1", "r2"))).alias("r")).select("r.*")
    return ops.deduplicate(reads, ["chrom", "start_", "seq"], "uid").select("uid", "chrom", "start_", "seq")


_MD = "CASE cigar WHEN '32M' THEN '10A21' WHEN '12M10N20M' THEN '5C8G17' WHEN '6S26M' THEN '0G25' WHEN '16M2D16M' THEN '15T0^AC10T5' ELSE '9A19C0' END"
_OFF = "CASE cigar WHEN '32M' THEN [[10, 10, 65]] WHEN '12M10N20M' THEN [[5, 5, 67], [14, 24, 71]] WHEN '6S26M' THEN [[6, 0, 71]] WHEN '16M2D16M' THEN [[15, 15, 84], [26, 28, 84]] ELSE [[9, 9, 65], [31, 29, 67]] END"


@query("rd_md_mismatches", WITH + f"SELECT * FROM (SELECT uid, x[1]::BIGINT AS off, (start_ + x[2])::BIGINT AS pos, chr(x[3]::INT) AS ref, substr(seq, (x[1] + 1)::INT, 1) AS alt FROM (SELECT *, unnest({_OFF}) AS x FROM r WHERE flag & 3844 = 0) y WHERE (instr('{_HEX}', substr(qualhex, (x[1] + 1)::INT, 1)) - 1) * 2 + 5 >= 20) z")
def md_mismatches(spark, sf_dir):
    """RD-06 by the tag MD, in the row."""
    reads = _reads(spark, sf_dir).withColumn("md", F.expr(_MD))
    found = sq.md_mismatches(F.col("start_"), F.col("cigar"), F.col("md"), F.col("seq"), F.col("quals"), 20)
    return reads.select("uid", F.explode(found).alias("m")).select("uid", F.col("m.offset").alias("off"), "m.pos", "m.ref", "m.alt")


@query("rd_soft_clips", WITH + "SELECT uid, CASE WHEN cigar = '6S26M' THEN 6 ELSE 0 END::BIGINT AS left_clip, 0::BIGINT AS right_clip, CASE WHEN cigar = '6S26M' THEN substr(seq, 7) ELSE seq END AS trimmed FROM r")
def soft_clips(spark, sf_dir):
    """RD-11."""
    left, right = sq.clip_lengths(F.col("cigar"))
    df = get(READS)(spark, sf_dir)[0].withColumns({"left_clip": left, "right_clip": right})
    return df.select("uid", "left_clip", "right_clip", F.substr("seq", (F.col("left_clip") + 1).cast("int"), (F.length("seq") - F.col("left_clip") - F.col("right_clip")).cast("int")).alias("trimmed"))


@query("rd_covered", WITH + "SELECT chrom, min(start_)::BIGINT AS start_, max(end_)::BIGINT AS end_, count(*) AS n, count(*) FILTER (flag & 4 <> 0) AS unmapped, bool_or(flag & 1 <> 0) AS paired FROM r GROUP BY chrom")
def covered(spark, sf_dir):
    """RD-07, RD-12, RD-14, LS-02."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    return get(READS)(spark, sf_dir)[0].groupBy("chrom").agg(F.min("start_").cast("long").alias("start_"), F.max("end_").cast("long").alias("end_"), F.count("*").alias("n"), F.count_if(flag(4)).alias("unmapped"), F.bool_or(flag(1)).alias("paired"))


@query("rd_feature_counts", WITH + "SELECT f.uid, count(r.uid) AS n, count(r.uid) FILTER (f.strand = CASE WHEN r.flag & 16 <> 0 THEN '-' ELSE '+' END) AS n_strand, count(r.uid) FILTER (r.nh = 1) AS n_unique FROM f LEFT JOIN r ON f.chrom = r.chrom AND f.start_ <= r.end_ AND r.start_ <= f.end_ AND f.start_ <= f.end_ AND r.flag & 3844 = 0 GROUP BY f.uid")
def feature_counts(spark, sf_dir):
    """RD-18, IJ-18."""
    feat, reads = get(FEAT, READS)(spark, sf_dir)
    reads = reads.filter(_GOOD).select("chrom", "start_", "end_", "nh", F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"))
    found = joins.annotate(feat, reads, ["uid"], F.count("*").alias("n"), F.count_if(F.col("strand") == F.col("r_strand")).alias("n_strand"), F.count_if(F.col("r_nh") == 1).alias("n_unique"))
    return found.select("uid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_strand", "n_unique")))


@query("rd_aligned_to", WITH + "SELECT f.uid AS feature, r.uid FROM f JOIN r ON f.chrom = r.chrom AND f.start_ <= r.end_ AND r.start_ <= f.end_ AND f.start_ <= f.end_ AND r.flag & 3844 = 0 WHERE list_sum(list_transform(" + _OPS.replace("cigar", "r.cigar") + ", lambda x: CASE WHEN x[4] = 1 THEN 0 ELSE greatest(0, least(r.start_ + x[2], f.end_) - greatest(r.start_ + x[1], f.start_) + 1) END)) >= 0.95 * list_sum(list_transform(" + _OPS.replace("cigar", "r.cigar") + ", lambda x: CASE WHEN x[4] = 1 THEN 0 ELSE x[2] - x[1] + 1 END))")
def aligned_to(spark, sf_dir):
    """IV-23, IV-24: reads of which 95 % of the aligned bases lie in a feature."""
    feat, reads = get(FEAT, READS)(spark, sf_dir)
    reads = reads.filter(_GOOD).select("uid", "chrom", "start_", "end_", sq.read_blocks(F.col("start_"), F.col("cigar")).alias("blocks"))
    pairs = joins.overlap_pairs(feat.select(F.col("uid").alias("feature"), "chrom", "start_", "end_", "strand"), reads)
    return pairs.filter(iv.blocks_inside(F.col("r_blocks"), iv.Interval.of())).select("feature", F.col("r_uid").alias("uid"))


_MINUS = "(flag & 16 <> 0) <> (flag & 128 <> 0)"
_TAGGED = _BASED + f", t AS (SELECT uid, chrom, nh, count(*) FILTER (ref = CASE WHEN {_MINUS} THEN 'A' ELSE 'T' END) AS xt, count(*) FILTER (ref = CASE WHEN {_MINUS} THEN 'A' ELSE 'T' END AND alt = CASE WHEN {_MINUS} THEN 'G' ELSE 'C' END) AS xc FROM b ANTI JOIN (SELECT chrom, pos FROM v WHERE (ref = 'T' AND alt = 'C') OR (ref = 'A' AND alt = 'G')) m ON m.chrom = b.chrom AND m.pos = b.pos GROUP BY ALL) "


def _tagged(spark, sf_dir) -> DataFrame:
    snp = "(ref = 'T' AND alt = 'C') OR (ref = 'A' AND alt = 'G')"
    masked = get(VAR)(spark, sf_dir)[0].filter(snp).select("chrom", "pos").distinct()
    return ops.tag_tc(_bases(spark, sf_dir).join(masked, ["chrom", "pos"], "left_anti"), ["uid", "chrom", "nh"])


@query("tl_tag_tc", _TAGGED + "SELECT uid, xt, xc FROM t WHERE xc >= 1")
def tag_tc(spark, sf_dir):
    """TL-01, TL-02, VC-05: conversions of each read, positions of T>C variants left out; reads with one at least."""
    return _tagged(spark, sf_dir).filter("xc >= 1").select("uid", "xt", "xc")


@query("tl_density", _TAGGED + "SELECT chrom, xt, xc, count(*) AS n, round(sum(1.0 / nh), 6) AS weighted FROM t GROUP BY chrom, xt, xc")
def density(spark, sf_dir):
    """TL-01: reads by convertible and converted bases, each once or by its number of hits."""
    return _tagged(spark, sf_dir).groupBy("chrom", "xt", "xc").agg(F.count("*").alias("n"), F.round(F.sum(F.lit(1.0) / F.col("nh")), 6).alias("weighted"))


@query("tl_quantise", WITH + "SELECT uid, least(9, greatest(0, ceil((score - lo) / ((hi - lo) / 10)) - 1))::BIGINT AS bin FROM f, (SELECT min(score) AS lo, max(score) AS hi FROM f) x")
def quantise(spark, sf_dir):
    """TL-06."""
    return ops.quantise(get(FEAT)(spark, sf_dir)[0], "score").select("uid", "bin")


@query("tl_prune_tags", WITH + "SELECT uid, 'NH:' || nh AS tags FROM r")
def prune_tags(spark, sf_dir):
    """TL-03: only the listed tags stay."""
    tags = F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("MQ"), F.col("mapq").cast("string"))
    kept = F.map_filter(tags, lambda k, v: k.isin("NH"))
    return get(READS)(spark, sf_dir)[0].select("uid", F.array_join(F.transform(F.map_entries(kept), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("tags"))


# --- text formats: lines are written from the tables, read by the readers' expressions, and compared with the tables


@query("sc_bed", WITH + "SELECT chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, strand, uid::VARCHAR AS name, floor(score)::INT AS score FROM f")
def bed(spark, sf_dir):
    """SC-01, SC-09, SK-05."""
    lines = text.bed_lines(get(FEAT)(spark, sf_dir)[0].withColumns({"name": F.col("uid"), "score": F.floor("score")}))
    return text.bed_rows(lines).select("chrom", "start_", "end_", "strand", "name", "score")


@query("sc_bedgraph", WITH + "SELECT chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, '+' AS strand, value FROM s")
def bedgraph(spark, sf_dir):
    """SC-08."""
    lines = get(SIGNAL)(spark, sf_dir)[0].select(F.concat_ws("\t", "chrom", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"), F.col("value").cast("string")).alias("value"))
    return text.bedgraph_rows(lines, strand="+")


@query("sc_gff", WITH + "SELECT chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, strand, 'exon' AS feature_type, 'tx' || tx_id AS parent, tx_type AS kind FROM e")
def gff(spark, sf_dir):
    """SC-13, SC-20, SK-07."""
    lines = text.gff_lines(get(EXON)(spark, sf_dir)[0].withColumns({"feature_type": F.lit("exon"), "Parent": F.concat(F.lit("tx"), "tx_id"), "kind": F.col("tx_type"), "note": F.lit(None).cast("string")}), "Parent", "kind", "note")
    return text.gff_rows(lines).select("chrom", "start_", "end_", "strand", "feature_type", F.col("attrs.Parent").alias("parent"), F.col("attrs.kind").alias("kind"))


@query("sc_gff_escaped", WITH + "SELECT uid, 'a;b=' || name || ',50%' AS note FROM f WHERE uid % 2 = 0")
def gff_escaped(spark, sf_dir):
    """SC-13, SK-07: reserved characters, and only some types."""
    rows = get(FEAT)(spark, sf_dir)[0].withColumns({"feature_type": F.when(F.col("uid") % 2 == 0, "gene").otherwise("exon"), "ID": F.col("uid"), "note": F.concat(F.lit("a;b="), "name", F.lit(",50%"))})
    got = text.gff_rows(text.gff_lines(rows, "ID", "note"), types=["gene"], decode=True)
    return got.select(F.col("attrs.ID").cast("long").alias("uid"), F.col("attrs.note").alias("note"))


@query("vc_samples", WITH + "SELECT uid, gt, '7' AS dp FROM v WHERE filter_ <> 'LowQual' AND gt <> './.'")
def samples(spark, sf_dir):
    """VC-03, VC-04: one of two samples, its FORMAT fields, rows in which it has a call."""
    v = get(VAR)(spark, sf_dir)[0]
    lines = v.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("uid").cast("string"), "ref", "alt", F.lit("50"), "filter_", F.lit("DP=1;DP=2"), F.lit("GT:DP"), F.lit("0/1:3"), F.concat("gt", F.lit(":7"))).alias("value"))
    got = text.vcf_rows(lines, samples=[1], only_called=True)
    return got.select(F.col("id").cast("long").alias("uid"), F.get("fields", 0)["GT"].alias("gt"), F.get("fields", 0)["DP"].alias("dp"))


@query("sc_gtf", WITH + "SELECT uid, replace(name, '#', '-') AS name, 'two words' AS note FROM f")
def gtf(spark, sf_dir):
    """SC-20, GTF: quotes go."""
    line = F.concat(F.lit('id "'), F.col("uid"), F.lit('"; gene_name "'), F.replace("name", F.lit("#"), F.lit("-")), F.lit('"; note "two words";'))
    df = get(FEAT)(spark, sf_dir)[0].select(text.parse_attributes(line, gtf=True).alias("a"))
    return df.select(F.col("a.id").cast("long").alias("uid"), F.col("a.gene_name").alias("name"), F.col("a.note").alias("note"))


@query("sc_vcf", WITH + """SELECT uid::VARCHAR AS id, chrom, CASE WHEN alt = '<DEL>' THEN pos WHEN length(ref) > length(alt) THEN pos + 1 ELSE pos END::BIGINT AS start_,
  CASE WHEN alt = '<DEL>' THEN pos + 20 WHEN length(ref) > length(alt) THEN pos + length(ref) - 1 ELSE pos END::BIGINT AS end_,
  CASE WHEN alt = '<DEL>' THEN 'SV' WHEN length(ref) > length(alt) THEN 'DEL' WHEN alt = 'ATT' THEN 'INS' ELSE 'SNP' END AS kind, gt, split_part(substr(info, 4), ';', 1) AS dp, 'true' AS db FROM v WHERE filter_ <> 'LowQual'""")
def vcf(spark, sf_dir):
    """SC-12, VC-02, VC-03, VC-04."""
    v = get(VAR)(spark, sf_dir)[0]
    lines = v.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.col("uid").cast("string"), "ref", "alt", F.lit("50"), "filter_", "info", F.lit("GT:DP"), F.concat("gt", F.lit(":7"))).alias("value"))
    got = text.vcf_rows(lines)
    return got.select("id", "chrom", "start_", "end_", "kind", F.get("genotypes", 0).alias("gt"), F.col("info.DP").alias("dp"), F.col("info.DB").alias("db"))


@query("vc_called", WITH + "SELECT chrom, count(*) AS n, count(*) FILTER (filter_ = 'LowQual') AS failed, count(*) FILTER (gt = './.') AS no_call, count(*) FILTER (filter_ <> 'LowQual' AND gt <> './.') AS kept FROM v GROUP BY chrom")
def called(spark, sf_dir):
    """VC-04: filters and their counts."""
    failed, none = F.col("filter_") == "LowQual", sq.zygosity(F.col("gt"))["called"] + sq.zygosity(F.col("gt"))["zyg"] == 0
    return get(VAR)(spark, sf_dir)[0].groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.count_if(none).alias("no_call"), F.count_if(~failed & ~none).alias("kept"))


@query("sc_sam", WITH + "SELECT name, flag::INT AS flag, chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, mapq::INT AS mapq, seq, nh::VARCHAR AS nh FROM r")
def sam(spark, sf_dir):
    """SC-18, SK-14."""
    lines = text.sam_lines(get(READS)(spark, sf_dir)[0].withColumns({"qual": F.lit("*"), "tags": F.create_map(F.lit("NH"), F.col("nh").cast("string"))}))
    return text.sam_rows(lines).select("name", "flag", "chrom", "start_", "end_", "strand", "mapq", "seq", F.col("tags.NH").alias("nh"))


@query("sk_tsv", WITH + "SELECT uid || chr(9) || coalesce(strand, 'NA') || chr(9) || name || ',NA' AS value FROM f")
def tsv(spark, sf_dir):
    """SK-13."""
    return text.tsv_lines(get(FEAT)(spark, sf_dir)[0].withColumn("list", F.array("name", F.lit(None).cast("string"))), "uid", "strand", "list")


@query("sk_block_cigar", WITH + "SELECT uid, CASE cigar WHEN '6S26M' THEN '26M' WHEN '16M2D16M' THEN '16M2N16M' WHEN '10M2I20M' THEN '10M0N20M' ELSE cigar END AS cigar FROM r")
def block_cigar(spark, sf_dir):
    """SK-14: the CIGAR of a read's aligned blocks."""
    return get(READS)(spark, sf_dir)[0].select("uid", text.blocks_cigar(sq.read_blocks(F.col("start_"), F.col("cigar"))).alias("cigar"))


_OFFSET = _BASED + f", c AS (SELECT uid, count(*) FILTER (t) AS xt, count(*) FILTER (t AND hit) AS xc, string_agg((rp - 1)::VARCHAR, ',' ORDER BY rp) FILTER (t AND hit) AS xm FROM (SELECT uid, rp, ref = CASE WHEN {_MINUS} THEN 'A' ELSE 'T' END AS t, alt = CASE WHEN {_MINUS} THEN 'G' ELSE 'C' END AS hit FROM b) x GROUP BY uid) "


@query("tl_tags", _OFFSET + "SELECT uid, xt, xc, coalesce(xm, '') AS xm, CASE WHEN xc > 0 THEN (255 - floor(255 * (xc / xt))::BIGINT) || ',0,0' END AS yc FROM c")
def tags(spark, sf_dir):
    """TL-01: all tags of a read, the places of conversions and the colour among them."""
    return ops.tag_tc(_bases(spark, sf_dir), ["uid"]).select("uid", "xt", "xc", "xm", "yc")
