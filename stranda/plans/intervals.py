"""Queries of interval algebra (IV), interval joins (IJ), aggregates (AG) and list checks (LS)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import EXON, FEAT, GENE, IV, SIGNAL, VAR
from ..functions import interval as iv
from ..operators import islands, joins, references, tables
from ..sources import regions
from .base import OVER, WITH, get, query

_B = {c: f"{c}b" for c in ("chrom", "start_", "end_", "strand", "score")}
_KEYED = "FROM f JOIN i ON f.uid = i.l_partkey"
_KEY = "f.uid, i.l_orderkey, i.l_linenumber, i.l_suppkey, i.l_partkey"
_KEYS = ("uid", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


def _keyed(spark, sf_dir):
    feat, ivs = get(FEAT, IV)(spark, sf_dir)
    return feat.join(ivs.withColumnsRenamed(_B), F.col("uid") == F.col("l_partkey")), iv.Interval.of(), iv.Interval.of(suffix="b")


@query("iv_order", WITH + f"SELECT {_KEY}, CASE WHEN f.chrom = i.chrom THEN f.start_ < i.start_ OR (f.start_ = i.start_ AND f.end_ < i.end_) END AS before, f.chrom = i.chrom AND f.start_ = i.start_ AS same_start, f.chrom = i.chrom AND f.end_ = i.end_ AS same_end {_KEYED}")
def order(spark, sf_dir):
    """IV-07, IV-08."""
    df, a, b = _keyed(spark, sf_dir)
    return df.select(*_KEYS, iv.before(a, b).alias("before"), iv.same_start(a, b).alias("same_start"), iv.same_end(a, b).alias("same_end"))


@query("iv_hull", WITH + f"SELECT {_KEY}, cast(least(f.start_, i.start_) AS bigint) AS start_, cast(greatest(f.end_, i.end_) AS bigint) AS end_ {_KEYED} AND f.chrom = i.chrom")
def hull(spark, sf_dir):
    """IV-13."""
    df, a, b = _keyed(spark, sf_dir)
    return df.withColumn("h", iv.hull(a, b)).filter("h IS NOT NULL").select(*_KEYS, "h.start_", "h.end_")


@query("iv_subtract", WITH + f"SELECT * FROM (SELECT {_KEY}, unnest(CASE WHEN {OVER} THEN [[f.start_, least(f.end_, i.start_ - 1)], [greatest(f.start_, i.end_ + 1), f.end_]] ELSE [[f.start_, f.end_]] END) AS p, {OVER} AS o {_KEYED}) x WHERE NOT o OR p[1] <= p[2]".replace("SELECT * FROM (", "SELECT uid, l_orderkey, l_linenumber, l_suppkey, l_partkey, p[1]::BIGINT AS start_, p[2]::BIGINT AS end_ FROM ("))
def subtract(spark, sf_dir):
    """IV-14."""
    df, a, b = _keyed(spark, sf_dir)
    return df.select(*_KEYS, F.explode(iv.subtract(a, b)).alias("p")).select(*_KEYS, "p.start_", "p.end_")


@query("iv_pieces", WITH + "SELECT uid, s AS start_, least(s + 9, end_) AS end_ FROM (SELECT uid, end_, unnest(range(start_, end_ + 1, 10)) AS s FROM f) x")
def pieces(spark, sf_dir):
    """IV-18, UD-08."""
    return get(FEAT)(spark, sf_dir)[0].select("uid", F.explode(iv.pieces(iv.Interval.of(), 10)).alias("p")).select("uid", F.col("p.start_").alias("start_"), F.col("p.end_").alias("end_"))


@query("iv_positions", WITH + "SELECT uid, unnest(range(start_, end_ + 1)) AS pos FROM f")
def positions(spark, sf_dir):
    """IV-21."""
    return get(FEAT)(spark, sf_dir)[0].select("uid", F.explode(iv.positions(iv.Interval.of())).alias("pos"))


@query("iv_text", WITH + "SELECT uid, chrom || ':' || start_ || '-' || end_ || coalesce(' (' || strand || ')', '') AS text, chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, strand, substr(chrom, 4) AS alias, chrom AS back, greatest(0, end_ - start_ + 1)::BIGINT AS size, start_ > end_ AS is_empty, strand IS NOT NULL AS stranded FROM f")
def text(spark, sf_dir):
    """IV-02, IV-03, IV-04, IV-05, IV-20, IV-22, SK-08: rendered, then parsed again."""
    a = iv.Interval.of()
    df = get(FEAT)(spark, sf_dir)[0].select("uid", iv.render(a).alias("text"), iv.length(a).alias("size"), iv.is_empty(a).alias("is_empty")).withColumn("p", iv.parse(F.col("text")))
    return df.select("uid", "text", "p.*", "size", "is_empty", F.col("p.strand").isNotNull().alias("stranded"), iv.toggle_chr(F.col("p.chrom")).alias("alias"), iv.toggle_chr(iv.toggle_chr(F.col("p.chrom"))).alias("back"))


@query("ij_hull_by_name", WITH + "SELECT name, CASE WHEN count(DISTINCT chrom) = 1 AND count(DISTINCT coalesce(strand, '.')) = 1 THEN min(start_) END::BIGINT AS start_, CASE WHEN count(DISTINCT chrom) = 1 AND count(DISTINCT coalesce(strand, '.')) = 1 THEN max(end_) END::BIGINT AS end_ FROM f GROUP BY name")
def hull_by_name(spark, sf_dir):
    """IJ-07: hull of a group if all its chromosomes and strands agree."""
    strand = F.coalesce("strand", F.lit("."))
    one = (F.min("chrom") == F.max("chrom")) & (F.min(strand) == F.max(strand))
    return get(FEAT)(spark, sf_dir)[0].groupBy("name").agg(F.when(one, F.min("start_")).cast("long").alias("start_"), F.when(one, F.max("end_")).cast("long").alias("end_"))


@query("ij_group_start", WITH + "SELECT chrom, start_, count(*) AS n, min(l_orderkey) AS first_key, max(end_)::BIGINT AS last_end FROM i GROUP BY chrom, start_")
def group_start(spark, sf_dir):
    """IJ-08, start."""
    return get(IV)(spark, sf_dir)[0].groupBy("chrom", "start_").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("end_").cast("long").alias("last_end"))


_MEMBERS = "string_agg(start_ || '-' || end_ || ':' || {0}, ',' ORDER BY start_, end_, {0}) AS members"


def _listed(df, column: str):
    return df.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat(m["start_"].cast("string"), F.lit("-"), m["end_"].cast("string"), F.lit(":"), m[column].cast("string"))), ","))


@query("ij_group_end", WITH + f"SELECT chrom, min(start_)::BIGINT AS start_, end_::BIGINT AS end_, count(*) AS n, {_MEMBERS.format('uid')} FROM f GROUP BY chrom, end_")
def group_end(spark, sf_dir):
    """IJ-08, end, with members."""
    return _listed(islands.groups(get(FEAT)(spark, sf_dir)[0], "end", ["uid"]), "uid")


@query("ij_group_both", WITH + f"SELECT chrom, strand, start_::BIGINT AS start_, end_::BIGINT AS end_, count(*) AS n, {_MEMBERS.format('l_orderkey')} FROM i GROUP BY chrom, strand, start_, end_")
def group_both(spark, sf_dir):
    """IJ-08, both ends, strands apart."""
    return _listed(islands.groups(get(IV)(spark, sf_dir)[0], "both", ["l_orderkey"], by=["chrom", "strand"]), "l_orderkey")


@query("ls_steps", WITH + "SELECT tx_id, " + ", ".join(f"coalesce(bool_and({c}), true) AS {m}" for m, c in {"dec": "start_ < before", "inceq": "start_ >= before", "dec1": "start_ = before - 1", "eq": "start_ = before"}.items()) + " FROM (SELECT tx_id, start_, lag(start_) OVER (PARTITION BY tx_id ORDER BY rnk) AS before FROM e) x GROUP BY tx_id")
def steps(spark, sf_dir):
    """LS-03: the modes that ls_monotone has not."""
    return islands.steps(get(EXON)(spark, sf_dir)[0], ["tx_id"], ["rnk"], "start_", ["dec", "inceq", "dec1", "eq"])


@query("ij_group_overlap", WITH + "SELECT chrom, uid, min(start_) OVER w AS group_start, max(end_) OVER w AS group_end FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start_, end_, uid ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_ > coalesce(max(end_) OVER (PARTITION BY chrom ORDER BY start_, end_, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM f WHERE start_ <= end_) a) b WINDOW w AS (PARTITION BY chrom, island)")
def group_overlap(spark, sf_dir):
    """IJ-08, overlap."""
    return islands.grouped(get(FEAT)(spark, sf_dir)[0], ["chrom"], ["uid"]).select("chrom", "uid", "group_start", "group_end")


@query("ij_merge_labels", WITH + "SELECT 'feat' AS label, chrom, start_::BIGINT AS start_, end_::BIGINT AS end_, uid AS id FROM f WHERE chrom IN (SELECT chrom FROM s) UNION ALL SELECT 'gene', chrom, start_::BIGINT, end_::BIGINT, gene_id FROM g WHERE chrom IN (SELECT chrom FROM s)")
def merge_labels(spark, sf_dir):
    """IJ-09: sources in one table with labels, on the chromosomes of a reference."""
    feat, gene, signal = get(FEAT, GENE, SIGNAL)(spark, sf_dir)
    part = lambda df, label, key: df.select(F.lit(label).alias("label"), "chrom", F.col("start_").cast("long").alias("start_"), F.col("end_").cast("long").alias("end_"), F.col(key).alias("id"))
    return part(feat, "feat", "uid").unionByName(part(gene, "gene", "gene_id")).join(signal.select("chrom").distinct(), "chrom", "left_semi")


@query("ij_tile_members", WITH + "SELECT t.chrom, t.tile, t.start_, t.end_, count(f.uid) AS n, coalesce(string_agg(f.uid::VARCHAR, ',' ORDER BY f.uid), '') AS members FROM (SELECT chrom, len, unnest(range(0, floor((len - 1) / 500.0)::BIGINT + 1)) AS tile, tile * 500 + 1 AS start_, least((tile + 1) * 500, len) AS end_ FROM (SELECT chrom, max(end_)::BIGINT AS len FROM f GROUP BY chrom) x) t LEFT JOIN f ON f.chrom = t.chrom AND f.start_ <= t.end_ AND t.start_ <= f.end_ AND f.start_ <= f.end_ GROUP BY ALL")
def tile_members(spark, sf_dir):
    """IJ-10, IJ-11: tiles of whole chromosomes, each with what overlaps it, or nothing."""
    feat = get(FEAT)(spark, sf_dir)[0]
    tiles = islands.tiles(feat, 500)
    found = joins.annotate(tiles, feat.select("chrom", "start_", "end_", "uid"), ["chrom", "tile"], F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("r_uid")), ",").alias("members"), bin_size=500)
    return found.select("chrom", "tile", "start_", "end_", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("members", F.lit("")).alias("members"))


@query("ij_refdict", WITH + "SELECT a.chrom, least(a.len, b.len)::BIGINT AS len, a.len = b.len AS agrees, substr(a.chrom, 4) AS alias FROM (SELECT chrom, max(end_) AS len FROM f GROUP BY chrom) a JOIN (SELECT chrom, max(end_) AS len FROM i GROUP BY chrom) b USING (chrom)")
def refdict(spark, sf_dir):
    """IJ-13, IJ-14, IJ-15: contigs that two tables share, with their lengths and aliases."""
    length = lambda df, name: df.groupBy("chrom").agg(F.max("end_").alias(name))
    feat, ivs = get(FEAT, IV)(spark, sf_dir)
    both = length(feat, "a").join(length(ivs, "b"), "chrom")
    return both.select("chrom", F.least("a", "b").cast("long").alias("len"), (F.col("a") == F.col("b")).alias("agrees"), iv.toggle_chr(F.col("chrom")).alias("alias"))


@query("ij_sorted", WITH + "SELECT uid, chrom, start_, end_ FROM f ORDER BY CASE chrom WHEN 'chr2' THEN 0 WHEN 'chr1' THEN 1 ELSE 2 END, chrom, start_ DESC, end_ DESC, uid LIMIT 100")
def in_order(spark, sf_dir):
    """IJ-16, LS-01: in the order of a reference's chromosomes, the first hundred; the sort is cut, not the table gathered."""
    feat = get(FEAT)(spark, sf_dir)[0]
    place = F.when(F.col("chrom") == "chr2", 0).when(F.col("chrom") == "chr1", 1).otherwise(2)
    return feat.orderBy(place, "chrom", F.desc("start_"), F.desc("end_"), "uid").limit(100).select("uid", "chrom", "start_", "end_")


@query("ij_query", WITH + "SELECT f.uid, x.kind, x.id, f.start_ <= x.start_ AND x.end_ <= f.end_ AS inside FROM f JOIN (SELECT 'gene' AS kind, chrom, start_, end_, gene_id AS id FROM g UNION ALL SELECT 'exon', chrom, start_, end_, tx_id * 10 + rnk FROM e) x ON f.chrom = x.chrom AND f.start_ <= x.end_ AND x.start_ <= f.end_ AND f.start_ <= f.end_")
def region_query(spark, sf_dir):
    """IJ-17: genes and exons in many query regions at once."""
    feat, gene, exon = get(FEAT, GENE, EXON)(spark, sf_dir)
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), "chrom", "start_", "end_", key.alias("id"))
    all_ = part(gene, "gene", F.col("gene_id")).unionByName(part(exon, "exon", F.col("tx_id") * 10 + F.col("rnk")))
    return joins.overlap_pairs(feat.select("uid", "chrom", "start_", "end_"), all_, bin_size=512).select("uid", F.col("r_kind").alias("kind"), F.col("r_id").alias("id"), ((F.col("start_") <= F.col("r_start_")) & (F.col("r_end_") <= F.col("end_"))).alias("inside"))


@query("ij_closest", WITH + f"SELECT uid, off, l_orderkey, l_linenumber FROM (SELECT f.uid, abs(f.start_ - i.start_) + abs(f.end_ - i.end_) AS off, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY f.uid ORDER BY abs(f.start_ - i.start_) + abs(f.end_ - i.end_), l_orderkey, l_linenumber) AS k FROM f JOIN i ON {OVER}) x WHERE k = 1")
def closest(spark, sf_dir):
    """IJ-22."""
    feat, ivs = get(FEAT, IV)(spark, sf_dir)
    return joins.closest(feat, ivs, ["uid"], "l_orderkey", "l_linenumber")


@query("ij_exact", WITH + "SELECT f.uid, count(*) AS n FROM f JOIN i ON f.chrom = i.chrom AND f.start_ = i.start_ AND f.end_ = i.end_ AND f.strand IS NOT DISTINCT FROM i.strand GROUP BY f.uid")
def exact(spark, sf_dir):
    """IJ-23."""
    feat, ivs = get(FEAT, IV)(spark, sf_dir)
    b = ivs.select(*(F.col(c).alias(f"r_{c}") for c in ("chrom", "start_", "end_", "strand")))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("start_") == F.col("r_start_")) & (F.col("end_") == F.col("r_end_")) & F.col("strand").eqNullSafe(F.col("r_strand"))
    return feat.join(b, on).groupBy("uid").agg(F.count("*").alias("n"))


@query("ag_counters", WITH + "SELECT chrom, coalesce(strand, '.') AS strand, count(*) AS n, count(DISTINCT name) AS names FROM f GROUP BY ALL")
def counters(spark, sf_dir):
    """AG-05, AG-06."""
    return get(FEAT)(spark, sf_dir)[0].groupBy("chrom", F.coalesce("strand", F.lit(".")).alias("strand")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("ag_ratio", WITH + "SELECT chrom, strand, round(sum(score * (end_ - start_ + 1)) / sum(end_ - start_ + 1), 4) AS ratio FROM i GROUP BY chrom, strand")
def ratio(spark, sf_dir):
    """AG-07."""
    size = F.col("end_") - F.col("start_") + 1
    return get(IV)(spark, sf_dir)[0].groupBy("chrom", "strand").agg(F.round(F.sum(F.col("score") * size) / F.sum(size), 4).alias("ratio"))


@query("ag_decay", WITH + "SELECT chrom, round(-sum(t * ln(y)) / sum(t * t), 6) AS k, round(ln(2) / (-sum(t * ln(y)) / sum(t * t)), 4) AS half_life FROM (SELECT chrom, l_linenumber::DOUBLE AS t, score / 200000 AS y FROM i) x GROUP BY chrom")
def decay(spark, sf_dir):
    """AG-09: exponential decay from 1, fitted on the logarithms."""
    df = get(IV)(spark, sf_dir)[0].select("chrom", F.col("l_linenumber").cast("double").alias("t"), (F.col("score") / 200000).alias("y"))
    k = -F.sum(F.col("t") * F.log("y")) / F.sum(F.col("t") * F.col("t"))
    return df.groupBy("chrom").agg(F.round(k, 6).alias("k"), F.round(F.lit(0.6931471805599453) / k, 4).alias("half_life"))


@query("ag_top", WITH + "SELECT name, n, least_score FROM (SELECT name, count(*) AS n, min(score) AS least_score FROM f GROUP BY name) x ORDER BY n DESC, name LIMIT 10")
def top(spark, sf_dir):
    """AG-11, AG-14."""
    return get(FEAT)(spark, sf_dir)[0].groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("least_score")).orderBy(F.desc("n"), "name").limit(10)


@query("ag_correlation", WITH + "SELECT chrom, round(corr(end_ - start_, score), 6) AS r FROM i GROUP BY chrom")
def correlation(spark, sf_dir):
    """AG-12."""
    return get(IV)(spark, sf_dir)[0].groupBy("chrom").agg(F.round(F.corr(F.col("end_") - F.col("start_"), "score"), 6).alias("r"))


@query("ls_monotone", WITH + "SELECT tx_id, coalesce(bool_and(start_ > before), true) AS inc, coalesce(bool_and(start_ <= before), true) AS deceq, coalesce(bool_and(rnk = last + 1), true) AS inc1 FROM (SELECT tx_id, start_, rnk, lag(start_) OVER w AS before, lag(rnk) OVER w AS last FROM e WINDOW w AS (PARTITION BY tx_id ORDER BY rnk)) x GROUP BY tx_id")
def monotone(spark, sf_dir):
    """LS-03."""
    w = Window.partitionBy("tx_id").orderBy("rnk")
    df = get(EXON)(spark, sf_dir)[0].select("tx_id", "start_", "rnk", F.lag("start_").over(w).alias("before"), F.lag("rnk").over(w).alias("last"))
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return df.groupBy("tx_id").agg(every(F.col("start_") > F.col("before")).alias("inc"), every(F.col("start_") <= F.col("before")).alias("deceq"), every(F.col("rnk") == F.col("last") + 1).alias("inc1"))


@query("ls_chunks", WITH + "SELECT gene_id, tx_id, rnk, ntile(3) OVER w::BIGINT AS part, floor((row_number() OVER w - 1) / 4.0)::BIGINT AS chunk FROM e WINDOW w AS (PARTITION BY gene_id ORDER BY tx_id, rnk)")
def chunks(spark, sf_dir):
    """LS-04: even parts, and chunks of a size."""
    w = Window.partitionBy("gene_id").orderBy("tx_id", "rnk")
    return get(EXON)(spark, sf_dir)[0].select("gene_id", "tx_id", "rnk", F.ntile(3).over(w).cast("long").alias("part"), F.floor((F.row_number().over(w) - 1) / 4).alias("chunk"))


@query("tx_set_overlap", WITH + "SELECT a.chrom AS a, b.chrom AS b, len(list_intersect(a.s, b.s))::BIGINT AS shared, (len(a.s) - len(list_intersect(a.s, b.s)))::BIGINT AS only_a, (len(b.s) - len(list_intersect(a.s, b.s)))::BIGINT AS only_b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM (SELECT chrom, list(DISTINCT name) AS s FROM f GROUP BY chrom) a JOIN (SELECT chrom, list(DISTINCT name) AS s FROM f GROUP BY chrom) b ON a.chrom < b.chrom")
def set_overlap(spark, sf_dir):
    """TX-24: set comparison as counts of a join on the elements; no set is gathered."""
    each = get(FEAT)(spark, sf_dir)[0].select("chrom", "name").distinct()
    size = each.groupBy("chrom").agg(F.count("*").alias("n"))
    a, b = (each.select(F.col("chrom").alias(x), "name") for x in "ab")
    shared = a.join(b, "name").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = size.select(F.col("chrom").alias("a"), F.col("n").alias("na")).join(F.broadcast(size.select(F.col("chrom").alias("b"), F.col("n").alias("nb"))), F.col("a") < F.col("b"))
    found = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    return found.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


@query("tx_duplicate_names", WITH + "SELECT name, count(*) AS n FROM f WHERE chrom = 'chr1' GROUP BY name HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    """TX-20."""
    return get(FEAT)(spark, sf_dir)[0].filter("chrom = 'chr1'").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


@query("ij_annotate_sides", WITH + "SELECT g.gene_id, " + ", ".join(
    f"coalesce({c}, '') AS {c}" for c in ("feats", "signals", "variants")
) + """ FROM g LEFT JOIN (SELECT gene_id, string_agg(uid, ',' ORDER BY f.start_, f.end_, uid) AS feats FROM g JOIN f ON f.chrom = g.chrom AND f.start_ <= g.end_ AND g.start_ <= f.end_ AND f.start_ <= f.end_ GROUP BY gene_id) a USING (gene_id)
LEFT JOIN (SELECT gene_id, string_agg(s.start_ || ':' || value::BIGINT, ',' ORDER BY s.start_, s.end_) AS signals FROM g JOIN s ON s.chrom = g.chrom AND s.start_ <= g.end_ AND g.start_ <= s.end_ GROUP BY gene_id) b USING (gene_id)
LEFT JOIN (SELECT gene_id, string_agg(alt, ',' ORDER BY pos, alt) AS variants FROM g JOIN v ON v.chrom = g.chrom AND v.pos BETWEEN g.start_ AND g.end_ AND v.chrom <> 'chr3' GROUP BY gene_id) c USING (gene_id)""")
def annotate_sides(spark, sf_dir):
    """IJ-01, IJ-18 with three labelled sides, one without a chromosome."""
    gene, feat, signal, var = get(GENE, FEAT, SIGNAL, VAR)(spark, sf_dir)
    sides = {"feats": feat.select("chrom", "start_", "end_", "uid"), "signals": signal, "variants": var.filter("chrom <> 'chr3'").select("chrom", F.col("pos").alias("start_"), F.col("pos").alias("end_"), "alt")}
    out = joins.annotate_sides(gene.select("gene_id", "chrom", "start_", "end_"), sides, ["gene_id"])
    text = lambda c, f: F.array_join(F.transform(c, lambda m: f(m).cast("string")), ",").alias(c)
    return out.select("gene_id", text("feats", lambda m: m["uid"]), text("signals", lambda m: F.concat_ws(":", m["start_"], m["value"].cast("long"))), text("variants", lambda m: m["alt"]))


@query("sc_region", WITH + "SELECT uid FROM f WHERE chrom = 'chr2' AND start_ <= 3000 AND end_ >= 250 AND start_ <= end_")
def region(spark, sf_dir):
    """SC-03, SC-07: lines with 0-based starts and other names of chromosomes."""
    lines = get(FEAT)(spark, sf_dir)[0].select(F.concat_ws("\t", "uid", (F.col("start_") - 1).cast("string"), F.col("end_").cast("string"), F.substring("chrom", 4, 9)).alias("value"))
    rows = regions.tsv_rows(lines, (3, 1, 2), (1, 0), "chr2:250-3000", {str(i): f"chr{i}" for i in range(1, 6)})
    return rows.select(F.get("fields", 0).cast("long").alias("uid"))


@query("ij_reference", WITH + "SELECT chrom, row_number() OVER (ORDER BY chrom) - 1 AS place, len AS length FROM (SELECT chrom, max(end_)::BIGINT AS len FROM f GROUP BY chrom) x WHERE chrom IN (SELECT chrom FROM i) AND chrom IN (SELECT chrom FROM s) AND chrom <> 'chr4'")
def reference(spark, sf_dir):
    """IJ-13, IJ-14: the chromosomes of three tables, in the same order; only one knows lengths."""
    feat, ivs, signal = get(FEAT, IV, SIGNAL)(spark, sf_dir)
    unknown = lambda df: references.by_scan(df).withColumn("length", F.lit(None).cast("long"))
    return references.merged(references.by_scan(feat), unknown(ivs), unknown(signal), check_order=True, included=["chr1", "chr2", "chr3", "chr5"])


_COLUMN = "SELECT '{0}' AS \"column\", count({0}) AS n, count(DISTINCT {0}) AS n_distinct, (SELECT {0}::VARCHAR FROM f WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0}::VARCHAR LIMIT 1) AS top, (SELECT count(*) FROM f WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC LIMIT 1) AS top_n, {1} FROM f"
_NUMBER = "round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS sd, min({0})::DOUBLE AS least, max({0})::DOUBLE AS most"
_NONE = "NULL::DOUBLE AS mean, NULL::DOUBLE AS sd, NULL::DOUBLE AS least, NULL::DOUBLE AS most"


@query("sk_describe", WITH + " UNION ALL ".join(_COLUMN.format(c, (_NUMBER if c in ("uid", "start_", "end_") else _NONE).format(c)) for c in ("uid", "chrom", "start_", "end_", "strand", "name")))
def describe(spark, sf_dir):
    """SK-03: columns of a located table."""
    out = tables.describe(get(FEAT)(spark, sf_dir)[0], ["uid", "chrom", "start_", "end_", "strand", "name"])
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("sk_located", WITH + ", m AS (SELECT count(*) AS n_merged FROM (SELECT start_ > coalesce(max(end_) OVER (PARTITION BY chrom ORDER BY start_, end_, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM f WHERE start_ <= end_) x WHERE new), c AS (SELECT count(*) AS n, count(*) FILTER (start_ > end_) AS n_empty FROM f) SELECT n, n_merged, n - n_empty > n_merged AS contains_overlapping, n_empty > 0 AS contains_empty FROM c, m")
def located(spark, sf_dir):
    """SK-03: whether intervals overlap or are empty."""
    return tables.located(get(FEAT)(spark, sf_dir)[0])


@query("ag_decay_fit", WITH.replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS (SELECT chrom, t, avg(y) AS y, count(*) AS n FROM (SELECT chrom, l_linenumber::DOUBLE AS t, score / 200000.0 AS y FROM i) a GROUP BY chrom, t),
  b AS (SELECT DISTINCT chrom, 0.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0 AS step FROM x UNION ALL SELECT chrom, CASE WHEN slope < 0 THEN mid ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE mid END, step + 1
    FROM (SELECT b.chrom, lo, hi, step, (lo + hi) / 2 AS mid, sum(n * t * exp(-(lo + hi) / 2 * t) * (y - exp(-(lo + hi) / 2 * t))) AS slope FROM b JOIN x ON b.chrom = x.chrom WHERE step < 50 GROUP BY b.chrom, lo, hi, step) c)
  SELECT chrom, round(lo, 6) AS k, round(ln(2) / lo, 4) AS half_life FROM b WHERE step = 50""")
def decay_fit(spark, sf_dir):
    """AG-09: exponential decay from 1 with the least squared error; the SQL halves an interval around the zero of the slope."""
    df = get(IV)(spark, sf_dir)[0].select("chrom", F.col("l_linenumber").alias("t"), (F.col("score") / 200000).alias("y"))
    fit = tables.fit_decay(df, ["chrom"], "t", "y")
    return fit.select("chrom", F.round("k", 6).alias("k"), F.round("half_life", 4).alias("half_life"))
