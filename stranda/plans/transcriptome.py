"""Queries of transcriptome building (TX) and of sequences (SQ)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import EXON, GENE, READS
from ..functions import sequence as sq
from ..operators import annotation, transcripts
from ..sources import text
from ..sources import transcriptome as files
from .base import WITH, get, query


def _lines(spark, sf_dir) -> DataFrame:
    """GFF3 lines of genes, transcripts and exons: some genes are missing, some too short, some transcripts are missing."""
    gene, exon = get(GENE, EXON)(spark, sf_dir)
    strand = lambda df: df.withColumn("strand", F.col("strand"))
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    genes = strand(gene.filter("gene_id % 7 <> 0")).withColumns({"end_": F.when(F.col("gene_id") % 10 == 3, F.col("end_") - 200).otherwise(F.col("end_")), "feature_type": F.lit("gene"), "ID": named("g", "gene_id"), "gene_type": F.when(F.col("gene_id") % 4 == 0, F.array(F.lit("pseudogene"))).when(F.col("gene_id") % 4 == 1, F.array(F.lit("coding"), F.lit("known")))})
    tx = exon.filter("tx_id % 11 <> 0").groupBy("tx_id").agg(F.min("gene_id").alias("gene_id"), F.min("chrom").alias("chrom"), F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.min("strand").alias("strand"))
    tx = tx.withColumns({"feature_type": F.lit("mRNA"), "ID": named("t", "tx_id"), "Parent": named("g", "gene_id")})
    parts = exon.withColumns({"feature_type": F.lit("exon"), "Parent": named("t", "tx_id")})
    return text.gff_lines(genes, "ID", "gene_type").unionByName(text.gff_lines(tx, "ID", "Parent")).unionByName(text.gff_lines(parts, "Parent"))


def _built(spark, sf_dir) -> annotation.Built:
    keep = annotation.Filter(not_chroms=["chr5"], fields={"gene": {"gene_type": (["coding", "other"], True)}})
    return annotation.build(text.gff_rows(_lines(spark, sf_dir)), annotation.FLAVOURS["generic", "gff"], keep)


_BUILD = WITH + """, gl AS (SELECT gene_id, chrom, start_ AS s, CASE WHEN gene_id % 10 = 3 THEN end_ - 200 ELSE end_ END AS e, CASE WHEN chrom = 'chr5' THEN 'chrom' WHEN gene_id % 4 = 0 THEN 'gene_type' END AS label FROM g WHERE gene_id % 7 <> 0),
tl AS (SELECT tx_id, min(gene_id) AS gene_id, min(chrom) AS chrom, min(start_) AS s, max(end_) AS e FROM e WHERE tx_id % 11 <> 0 GROUP BY tx_id),
tk AS (SELECT tl.*, gl.gene_id IS NULL AS missing, CASE WHEN tl.chrom = 'chr5' THEN 'chrom' WHEN gl.label IS NOT NULL THEN 'parent_filtered' WHEN gl.gene_id IS NOT NULL AND NOT (gl.s <= tl.s AND tl.e <= gl.e) THEN 'not_enveloped' ELSE 'kept' END AS label FROM tl LEFT JOIN gl USING (gene_id)),
gk AS (SELECT gl.*, coalesce(label, CASE WHEN gene_id NOT IN (SELECT gene_id FROM tk WHERE label = 'kept') THEN 'empty' END, 'kept') AS final FROM gl),
made AS (SELECT gene_id, min(s) AS s, max(e) AS e FROM tk WHERE missing AND label = 'kept' GROUP BY gene_id),
pk AS (SELECT e.*, CASE WHEN e.chrom = 'chr5' THEN 'chrom' WHEN tk.tx_id IS NULL THEN 'orphan' ELSE 'kept' END AS label FROM e LEFT JOIN (SELECT * FROM tk WHERE label = 'kept') tk ON e.tx_id = tk.tx_id) """


@query("tx_build", _BUILD + """SELECT 'gene' AS kind, 'g' || gene_id AS id, NULL AS parent, s::BIGINT AS start_, e::BIGINT AS end_ FROM gk WHERE final = 'kept' UNION ALL SELECT 'gene', 'g' || gene_id, NULL, s, e FROM made
  UNION ALL SELECT 'transcript', 't' || tx_id, 'g' || gene_id, s, e FROM tk WHERE label = 'kept'
  UNION ALL SELECT 'part', 't' || tx_id || '_exon_' || (row_number() OVER (PARTITION BY tx_id ORDER BY start_, end_) - 1), 't' || tx_id, start_, end_ FROM pk WHERE label = 'kept'""")
def build(spark, sf_dir):
    """TX-01 to TX-04, TX-06, TX-11, TX-14."""
    return _built(spark, sf_dir).features.select("kind", "id", "parent", "start_", "end_")


@query("tx_build_log", _BUILD + """SELECT 'gene' AS kind, final AS label, count(*) AS n FROM gk GROUP BY final UNION ALL SELECT 'gene', 'made', count(*) FROM made HAVING count(*) > 0
  UNION ALL SELECT 'transcript', label, count(*) FROM tk GROUP BY label UNION ALL SELECT 'part', label, count(*) FROM pk GROUP BY label""")
def build_log(spark, sf_dir):
    """TX-13."""
    return _built(spark, sf_dir).log


@query("tx_descendants", _BUILD + """SELECT 't' || tx_id AS id FROM tk WHERE label = 'kept' AND gene_id IN (1, 2, 14) UNION ALL SELECT 'g' || gene_id FROM gk WHERE final = 'kept' AND gene_id IN (1, 2, 14) UNION ALL SELECT 'g' || gene_id FROM made WHERE gene_id IN (1, 2, 14)""")
def descendants(spark, sf_dir):
    """TX-15, TX-17."""
    return annotation.descendants(_built(spark, sf_dir).features, ["g1", "g2", "g14"]).filter("kind <> 'part'").select("id")


@query("tx_enveloped", WITH + """, p AS (SELECT *, CASE WHEN gene_id % 3 = 0 THEN start_ + 60 ELSE start_ END AS s, CASE WHEN gene_id % 5 = 0 THEN end_ - 60 ELSE end_ END AS e FROM g)
SELECT 'x' || tx_id || '_' || rnk AS id, 'g' || gene_id AS parent FROM e JOIN p USING (gene_id) WHERE e.start_ < p.s OR e.end_ > p.e""")
def enveloped(spark, sf_dir):
    """TX-09: features outside their parent, of genes some of which were cut at one end."""
    gene, exon = get(GENE, EXON)(spark, sf_dir)
    cut = {"start_": F.when(F.col("gene_id") % 3 == 0, F.col("start_") + 60).otherwise(F.col("start_")), "end_": F.when(F.col("gene_id") % 5 == 0, F.col("end_") - 60).otherwise(F.col("end_"))}
    place = ["id", "parent", "chrom", "start_", "end_"]
    genes = gene.withColumns(cut).withColumns({"id": F.concat(F.lit("g"), "gene_id"), "parent": F.lit(None).cast("string")}).select(*place)
    exons = exon.withColumns({"id": F.concat(F.lit("x"), "tx_id", F.lit("_"), "rnk"), "parent": F.concat(F.lit("g"), "gene_id")}).select(*place)
    return annotation.outside_parent(genes.unionByName(exons))


@query("tx_nearest_attribute", WITH + """, x AS (SELECT 'x' || tx_id || '_' || rnk AS id, 't' || tx_id AS t, 'g' || gene_id AS g, tx_id, gene_id, rnk FROM e),
n AS (SELECT id, CASE WHEN rnk % 5 = 0 THEN id WHEN tx_id % 3 = 0 THEN t WHEN gene_id % 2 = 0 THEN g END AS owner FROM x UNION ALL
  SELECT DISTINCT t, CASE WHEN tx_id % 3 = 0 THEN t WHEN gene_id % 2 = 0 THEN g END FROM x UNION ALL SELECT DISTINCT g, CASE WHEN gene_id % 2 = 0 THEN g END FROM x)
SELECT id, owner, 'v' || owner AS value FROM n WHERE owner IS NOT NULL""")
def nearest_attribute(spark, sf_dir):
    """TX-18, TX-19: values of exons, else of their transcripts, else of their genes."""
    e = get(EXON)(spark, sf_dir)[0].select(F.concat(F.lit("x"), "tx_id", F.lit("_"), "rnk").alias("x"), F.concat(F.lit("t"), "tx_id").alias("t"), F.concat(F.lit("g"), "gene_id").alias("g"), "tx_id", "gene_id", "rnk")
    level = lambda i, up, has: e.select(F.col(i).alias("id"), (F.col(up) if up else F.lit(None).cast("string")).alias("parent"), F.expr(has).alias("has")).distinct()
    all_ = level("x", "t", "rnk % 5 = 0").unionByName(level("t", "g", "tx_id % 3 = 0")).unionByName(level("g", None, "gene_id % 2 = 0"))
    return annotation.find_attribute(all_, all_.filter("has").select("id", F.concat(F.lit("v"), "id").alias("value")))


@query("tx_flavours", WITH + """, m AS (SELECT tx_id, min(gene_id) AS gene_id, min(chrom) AS chrom, min(start_) AS s, max(end_) AS e FROM e GROUP BY tx_id),
t AS (SELECT *, ['mRNA', 'ncRNA', 'lnc_RNA', 'tRNA', 'pseudogene', 'snRNA', 'odd'][tx_id % 7 + 1] AS raw FROM m),
u AS (SELECT * FROM t WHERE raw NOT IN ('odd', 'pseudogene'))
SELECT 'transcript' AS kind, tx_id::VARCHAR AS id, raw AS raw_type, NULL AS gene_name, s::BIGINT AS start_, e::BIGINT AS end_ FROM u
UNION ALL SELECT 'gene', gene_id::VARCHAR, NULL, CASE WHEN gene_id % 3 = 0 THEN 'renamed' ELSE 'n' || gene_id END, min(s), max(e) FROM u GROUP BY gene_id
UNION ALL SELECT 'custom', tx_id::VARCHAR, 'odd', NULL, s, e FROM t WHERE raw = 'odd'""")
def flavours(spark, sf_dir):
    """TX-01, TX-03, TX-05, TX-14: types of UCSC's GTF, genes made and named by an alias table, a custom type; pseudogenes are none of its types."""
    tx = get(EXON)(spark, sf_dir)[0].groupBy("tx_id").agg(F.min("gene_id").alias("gene_id"), F.min("chrom").alias("chrom"), F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.min("strand").alias("strand"))
    raw = F.element_at(F.array(*map(F.lit, ("mRNA", "ncRNA", "lnc_RNA", "tRNA", "pseudogene", "snRNA", "odd"))), (F.col("tx_id") % 7 + 1).cast("int"))
    info = F.create_map(F.lit("transcript_id"), F.col("tx_id").cast("string"), F.lit("gene_id"), F.col("gene_id").cast("string"), F.lit("gene_name"), F.concat(F.lit("n"), "gene_id"))
    names = tx.filter("gene_id % 3 = 0").select(F.concat(F.lit("n"), "gene_id").alias("alias"), F.lit("renamed").alias("name")).distinct()
    built = annotation.build(tx.withColumns({"feature_type": raw, "attrs": info}), annotation.FLAVOURS["ucsc", "gtf"], custom=["odd"], names=names)
    return built.features.select("kind", "id", "raw_type", "gene_name", "start_", "end_")


@query("seq_rna_mod3", WITH + "SELECT tx_id, (sum(end_ - start_ + 1) % 3)::BIGINT AS rest FROM e GROUP BY tx_id")
def mod3(spark, sf_dir):
    """SQ-20."""
    return get(EXON)(spark, sf_dir)[0].groupBy("tx_id").agg((F.sum(F.col("end_") - F.col("start_") + 1) % 3).alias("rest"))


_RANKED = "SELECT *, coalesce(sum(end_ - start_ + 1) OVER (PARTITION BY tx_id ORDER BY CASE WHEN strand = '-' THEN -end_ ELSE start_ END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM e"


@query("seq_aligned_blocks", WITH + f"SELECT tx_id, (CASE WHEN strand = '-' THEN end_ - hi + 1 ELSE start_ + lo - 1 END)::BIGINT AS start_, (CASE WHEN strand = '-' THEN end_ - lo + 1 ELSE start_ + hi - 1 END)::BIGINT AS end_ FROM (SELECT *, greatest(11 - off, 1) AS lo, least(60 - off, end_ - start_ + 1) AS hi FROM ({_RANKED}) x) y WHERE lo <= hi")
def aligned_blocks(spark, sf_dir):
    """SQ-16, SQ-17: genomic blocks of the spliced positions 11 to 60."""
    out = transcripts.to_genomic(get(EXON)(spark, sf_dir)[0], 11, 60)
    return out.select("tx_id", F.col("start_").cast("long").alias("start_"), F.col("end_").cast("long").alias("end_"))


_CLAMP = "greatest(0, least({}, end_ - start_ + 1))"


@query("seq_rel_interval", WITH + f"SELECT tx_id, q_start, q_end, (sum(CASE WHEN strand = '-' THEN {_CLAMP.format('end_ - q_end')} ELSE {_CLAMP.format('q_start - start_')} END) + 1)::BIGINT AS rel_start, sum(CASE WHEN strand = '-' THEN {_CLAMP.format('end_ - q_start + 1')} ELSE {_CLAMP.format('q_end - start_ + 1')} END)::BIGINT AS rel_end FROM (SELECT *, min(start_) OVER (PARTITION BY tx_id) + 20 AS q_start, max(end_) OVER (PARTITION BY tx_id) - 20 AS q_end FROM e) x GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY tx_id, q_start, q_end"))
def rel_interval(spark, sf_dir):
    """SQ-15 for intervals, introns too."""
    exon = get(EXON)(spark, sf_dir)[0]
    inner = exon.groupBy("tx_id").agg((F.min("start_") + 20).alias("q_start"), (F.max("end_") - 20).alias("q_end"))
    return transcripts.interval_to_spliced(exon.select("tx_id", "strand", "start_", "end_"), inner)


@query("seq_measures", WITH + "SELECT uid, translate(seq, 'ACGT', 'TGCA') AS complement, (contains(seq, 'GATC')::INT + contains(seq, 'CCGG')::INT)::BIGINT AS n_sites, greatest(list_max(list_transform(regexp_extract_all(seq, 'A+'), lambda x: length(x))), list_max(list_transform(regexp_extract_all(seq, 'C+'), lambda x: length(x))), list_max(list_transform(regexp_extract_all(seq, 'G+'), lambda x: length(x))), list_max(list_transform(regexp_extract_all(seq, 'T+'), lambda x: length(x))))::BIGINT AS longest, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6) AS gc FROM r")
def measures(spark, sf_dir):
    """SQ-02, SQ-03, SQ-04, SQ-05."""
    s = F.col("seq")
    return get(READS)(spark, sf_dir)[0].select("uid", sq.complement(s).alias("complement"), sq.count_sites(s, ["GATC", "CCGG"]).alias("n_sites"), sq.longest_homopolymer(s).alias("longest"), F.round(sq.gc_fraction(s), 6).alias("gc"))


@query("seq_windows", WITH + "SELECT uid, k AS n, rpad(substr(seq, (k * 7 + 1)::INT, 10), 10, 'N') AS w FROM r, (SELECT unnest(range(0, 5)) AS k) x WHERE k <= ceil((32 - 10) / 7.0)")
def windows(spark, sf_dir):
    """SQ-09."""
    return get(READS)(spark, sf_dir)[0].select("uid", F.posexplode(sq.windows(F.col("seq"), 10, 7)).alias("n", "w")).select("uid", F.col("n").cast("long").alias("n"), "w")


@query("seq_fasta", WITH + "SELECT uid, '>r' || uid || chr(10) || substr(seq, 1, 12) || chr(10) || substr(seq, 13, 12) || chr(10) || substr(seq, 25) AS record, 'NNN' || substr(seq, 1, 6) || 'NNNN' AS padded FROM r")
def fasta(spark, sf_dir):
    """SQ-10, SK-13."""
    return get(READS)(spark, sf_dir)[0].select("uid", F.concat(F.lit(">r"), F.col("uid").cast("string"), F.lit("\n"), sq.wrap(F.col("seq"), 12)).alias("record"), sq.pad_n(F.substring("seq", 1, 6), 13).alias("padded"))


_GFF = "SELECT concat_ws(chr(9), 'chr' || (gene_id % 5 + 1), 'stranda', type, s::BIGINT, e::BIGINT, '.', CASE gene_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END, '.', info) AS value FROM "


@query("sk_gff3", _BUILD + _GFF + """(SELECT gene_id, 'gene' AS type, s, e, 'ID=g' || gene_id || ';gene_name=g' || gene_id || CASE WHEN gene_id % 4 = 1 THEN ';gene_type=coding,known' ELSE '' END AS info FROM gk WHERE final = 'kept'
  UNION ALL SELECT gene_id, 'gene', s, e, 'ID=g' || gene_id || ';gene_name=g' || gene_id FROM made UNION ALL SELECT gene_id, 'transcript', s, e, 'ID=t' || tx_id || ';Parent=g' || gene_id FROM tk WHERE label = 'kept'
  UNION ALL SELECT gene_id, 'exon', start_, end_, 'ID=t' || tx_id || '_exon_' || (row_number() OVER (PARTITION BY tx_id ORDER BY start_, end_) - 1) || ';Parent=t' || tx_id FROM pk WHERE label = 'kept') x""")
def gff3(spark, sf_dir):
    """SK-07: a built transcriptome."""
    return files.gff3_lines(_built(spark, sf_dir).features, copied=("gene_type",))


@query("sk_bed12", WITH + """, t AS (SELECT tx_id, min(gene_id) AS gene_id, min(start_) AS s, max(end_) AS e, min(start_) FILTER (rnk IN (2, 3)) AS ts, max(end_) FILTER (rnk IN (2, 3)) AS te, count(*) AS n, string_agg((end_ - start_ + 1)::VARCHAR, ',' ORDER BY start_, end_) AS sizes FROM e GROUP BY tx_id),
  b AS (SELECT tx_id, string_agg((start_ - s)::VARCHAR, ',' ORDER BY start_, end_) AS starts FROM e JOIN t USING (tx_id) GROUP BY tx_id)
  SELECT 't' || tx_id AS tx_id, concat_ws(chr(9), 'chr' || (gene_id % 5 + 1), s - 1, e, 't' || tx_id, '.', CASE gene_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END, coalesce(ts, s) - 1, coalesce(te, e), CASE gene_id % 3 WHEN 1 THEN '255,153,153' ELSE '153,255,153' END, n, sizes, starts) AS value FROM t JOIN b USING (tx_id)""")
def bed12(spark, sf_dir):
    """SK-06: transcripts whose second and third exon are coding; genes are made, as no row has one."""
    exon = get(EXON)(spark, sf_dir)[0]
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    tx = exon.groupBy("tx_id").agg(F.min("gene_id").alias("gene_id"), F.min("chrom").alias("chrom"), F.min("start_").alias("start_"), F.max("end_").alias("end_"), F.min("strand").alias("strand"))
    tx = tx.withColumns({"feature_type": F.lit("mRNA"), "ID": named("t", "tx_id"), "Parent": named("g", "gene_id")})
    parts = exon.withColumn("feature_type", F.explode(F.when(F.col("rnk").isin(2, 3), F.array(F.lit("exon"), F.lit("CDS"))).otherwise(F.array(F.lit("exon"))))).withColumn("Parent", named("t", "tx_id"))
    lines = text.gff_lines(tx, "ID", "Parent").unionByName(text.gff_lines(parts, "Parent"))
    return files.bed12_lines(annotation.build(text.gff_rows(lines), annotation.FLAVOURS["generic", "gff"]).features)


@query("seq_base_positions", WITH + """SELECT tx_id, md5(string_agg(pos::VARCHAR, ',' ORDER BY k)) AS positions, md5(coalesce(string_agg(gap::VARCHAR, ',' ORDER BY k), '')) AS gaps FROM (SELECT *, abs(lead(pos) OVER (PARTITION BY tx_id ORDER BY k) - pos) - 1 AS gap
  FROM (SELECT tx_id, pos, CASE WHEN strand = '-' THEN -pos ELSE pos END AS k FROM (SELECT tx_id, strand, unnest(range(start_, end_ + 1)) AS pos FROM e) x) y) z GROUP BY tx_id""")
def base_positions(spark, sf_dir):
    """SQ-16: positions of spliced bases and the gaps between them, as digests."""
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return transcripts.base_positions(get(EXON)(spark, sf_dir)[0]).select("tx_id", digest("positions").alias("positions"), digest("gaps").alias("gaps"))


@query("seq_3end_whole", WITH + "SELECT tx_id, start_, end_ FROM (SELECT tx_id, CASE WHEN strand = '-' THEN start_ ELSE end_ - least(size, 60 - after) + 1 END AS start_, CASE WHEN strand = '-' THEN start_ + least(size, 60 - after) - 1 ELSE end_ END AS end_, after FROM (SELECT *, end_ - start_ + 1 AS size, cast(coalesce(sum(end_ - start_ + 1) OVER (PARTITION BY tx_id ORDER BY CASE WHEN strand = '-' THEN start_ ELSE -end_ END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS after FROM e WHERE tx_id IN (SELECT tx_id FROM e GROUP BY tx_id HAVING sum(end_ - start_ + 1) >= 60)) a) b WHERE after < 60")
def whole_ends(spark, sf_dir):
    """SQ-18: only of transcripts that are long enough."""
    return transcripts.last_bases(get(EXON)(spark, sf_dir)[0], 60, partial=False).select("tx_id", "start_", "end_")


@query("seq_longest_runs", WITH + "SELECT uid, list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x)))::BIGINT AS hp, coalesce(list_max(list_transform(regexp_extract_all(seq, '[GC]+'), lambda x: length(x))), 0)::BIGINT AS gc FROM r")
def longest_runs(spark, sf_dir):
    """SQ-05, SQ-06: both in one."""
    return get(READS)(spark, sf_dir)[0].select("uid", sq.longest_runs(F.col("seq")).alias("x")).select("uid", "x.hp", "x.gc")
