"""Position, run, window and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions as ps
from .bridge import view, with_
from .registry import query

AB = "pos_a pos_b"


def _ab(s, d):
    return view(s, d, "pos_a"), view(s, d, "pos_b")


@query("SET01_union", with_(AB, "SELECT chrom, pos, min(src) AS src FROM (SELECT chrom, pos, 0 AS src FROM pos_a UNION ALL SELECT chrom, pos, 1 FROM pos_b) GROUP BY chrom, pos"))
def _(s, d):
    return ps.union(*_ab(s, d))


@query("SET02_intersection", with_(AB, "SELECT * FROM pos_a SEMI JOIN pos_b USING (chrom, pos)"))
def _(s, d):
    return ps.intersection(*_ab(s, d))


@query("SET03_difference", with_(AB, "SELECT * FROM pos_a ANTI JOIN pos_b USING (chrom, pos)"))
def _(s, d):
    return ps.difference(*_ab(s, d))


@query("SET04_symmetric_difference", with_(AB, "SELECT * FROM pos_a ANTI JOIN pos_b USING (chrom, pos) UNION ALL SELECT * FROM pos_b ANTI JOIN pos_a USING (chrom, pos)"))
def _(s, d):
    return ps.symmetric_difference(*_ab(s, d))


@query("SET05_fold", with_(AB, "SELECT chrom, pos FROM pos_a SEMI JOIN pos_b USING (chrom, pos) WHERE pos % 5 <> 1"))
def _(s, d):
    a, b = _ab(s, d)
    return ps.difference(ps.fold([a, b], "intersection"), a.filter("pos % 5 = 1"))


@query("SNK07_bed", with_("pos_a", "SELECT chrom, pos - 1 AS start, pos AS \"end\" FROM pos_a"))
def _(s, d):
    return ps.to_bed(view(s, d, "pos_a"))


@query("SNK08_pos", with_("pos_a", "SELECT chrom, pos FROM pos_a"))
def _(s, d):
    return ps.to_pos(ps.to_bed(view(s, d, "pos_a")))


@query("SRC21_lengths", with_("genes", "SELECT gene, end_pos - start_pos AS length, CASE WHEN end_pos - start_pos = 1 THEN end_pos END AS pos FROM genes"))
def _(s, d):
    g = view(s, d, "genes").select("gene", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    return ps.lengths(g).select("gene", "length", "pos")


@query("WIN01_mhap_codes", with_("variants", """WITH r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM mhapidx THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS run FROM (SELECT *, lag(mhapidx, 1, mhapidx) OVER (ORDER BY pos) AS p FROM variants)),
  f AS (SELECT *, first_value(pos) OVER w AS f, first_value(chrom) OVER w AS c FROM r WINDOW w AS (PARTITION BY run ORDER BY pos))
  SELECT CAST(run AS BIGINT) AS run, mhapidx, c || ':' || f || coalesce(':' || string_agg(CASE WHEN pos > f THEN CAST(pos - f AS VARCHAR) END, ',' ORDER BY pos), '') AS code FROM f GROUP BY run, mhapidx, c, f"""))  # fmt: skip
def _(s, d):
    return ps.mhap_codes(view(s, d, "variants"))


_GENE = "WITH g AS (SELECT v.pos, v.chrom, gene FROM variants v LEFT JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN start_pos AND end_pos), x AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS idx FROM g)"


def _genes(s, d):
    v, g = view(s, d, "variants").select("pos", "chrom"), view(s, d, "genes")
    return v.join(ps.in_intervals(v, g).select("pos", "gene"), "pos", "left")


@query("WIN02_gene_runs", with_("variants genes", f"{_GENE}, r AS (SELECT *, sum(CASE WHEN gene IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS run FROM (SELECT *, lag(gene) OVER (ORDER BY pos) AS p FROM x)) SELECT gene, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r WHERE gene IS NOT NULL GROUP BY run, gene"))
def _(s, d):
    return ps.gene_runs(_genes(s, d))


@query("WIN03_chrom_runs", with_("variants", "SELECT chrom, min(pos) AS first, max(pos) AS last, count(*) AS n FROM variants GROUP BY chrom"))
def _(s, d):
    return ps.chrom_runs(view(s, d, "variants"))


@query("WIN04_gene_segments", with_("variants genes", f"{_GENE}, y AS (SELECT * FROM x WHERE gene IS NOT NULL), r AS (SELECT *, sum(CASE WHEN gene IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS run FROM (SELECT *, lag(gene) OVER (ORDER BY pos) AS p FROM y)) SELECT gene, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r GROUP BY run, gene HAVING max(idx) - min(idx) > 3"))
def _(s, d):
    return ps.gene_runs(_genes(s, d), skip_null=True, longer_than=3)


@query("WIN05_sliding_windows", with_("pos_a", """WITH w AS (SELECT chrom, pos, max(pos) OVER r AS last, count(*) OVER r AS n FROM pos_a WINDOW r AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING)),
  e AS (SELECT *, max(CASE WHEN n >= 3 THEN last END) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM w)
  SELECT chrom, pos AS first, last, n FROM e WHERE n >= 3 AND (edge IS NULL OR last > edge)"""))  # fmt: skip
def _(s, d):
    return ps.sliding_windows(view(s, d, "pos_a"), size=20)


@query("JOIN01_metadata", with_("samples", "SELECT s_suppkey AS sample_id, country, pop AS area FROM supplier JOIN samples ON s_suppkey = sample_id"))
def _(s, d):
    own = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("sample_id"))
    return ps.join_metadata(own, view(s, d, "samples"), "sample_id", {"country": "country", "pop": "area"})


@query("JOIN01_unmatched", with_("samples", "SELECT s_suppkey AS sample_id FROM supplier WHERE s_suppkey NOT IN (SELECT sample_id FROM samples WHERE pop <> 'ASIA')"))
def _(s, d):
    own = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("sample_id"))
    return ps.unmatched(own, view(s, d, "samples").filter("pop <> 'ASIA'"), "sample_id")


@query("JOIN02_left_metadata", with_("samples", "SELECT s_suppkey AS sample_id, country, pop FROM supplier LEFT JOIN (SELECT * FROM samples WHERE pop = 'EUROPE') e ON s_suppkey = sample_id"))
def _(s, d):
    own = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("sample_id"))
    return ps.join_metadata(own, view(s, d, "samples").filter("pop = 'EUROPE'"), "sample_id", how="left")


@query("JOIN03_row_zip", with_("variants genes", "SELECT a.pos, b.gene FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS r FROM variants) a JOIN (SELECT gene, row_number() OVER (ORDER BY start_pos) AS r FROM genes) b USING (r)"))
def _(s, d):
    return ps.zip_rows(view(s, d, "variants").select("pos"), view(s, d, "genes").select("gene", "start_pos"), "pos", "start_pos").select("pos", "gene")


@query("JOIN04_lookup", with_(AB, "SELECT b.chrom, b.pos, max(a.pos * 10) AS idx FROM pos_b b LEFT JOIN pos_a a USING (chrom, pos) GROUP BY b.chrom, b.pos"))
def _(s, d):
    a, b = _ab(s, d)
    return ps.lookup(b, a.withColumn("idx", F.col("pos") * 10))


@query("JOIN05_select_in_order", with_(AB, "SELECT chrom, pos, 1000 - pos AS ord FROM pos_a JOIN pos_b USING (chrom, pos)"))
def _(s, d):
    a, b = _ab(s, d)
    return ps.select_positions(a, b.withColumn("ord", 1000 - F.col("pos")))


@query("JOIN06_in_genes", with_("variants genes", "SELECT v.pos, v.chrom, gene FROM variants v JOIN genes g ON v.chrom = g.chrom AND v.pos BETWEEN start_pos AND end_pos"))
def _(s, d):
    return ps.in_intervals(view(s, d, "variants").select("pos", "chrom"), view(s, d, "genes")).select("pos", "chrom", "gene")


@query("JOIN07_label_lookup", with_("seqs", "SELECT doc_id, quality FROM seqs JOIN labels USING (doc_id)"))
def _(s, d):
    return view(s, d, "seqs").select("doc_id").join(s.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id")


@query("JOIN08_pairs", with_("samples", "SELECT a.sample_id AS i, b.sample_id AS j, a.pop FROM samples a JOIN samples b ON a.pop = b.pop AND a.sample_id < b.sample_id"))
def _(s, d):
    return ps.pairs_within(view(s, d, "samples").select("sample_id", "pop"), "pop", "sample_id")


@query("JOIN09_groups", with_("samples", "SELECT pop, count(*) AS n, list(sample_id ORDER BY sample_id) AS members FROM samples GROUP BY pop"))
def _(s, d):
    return view(s, d, "samples").groupBy("pop").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("sample_id")).alias("members"))
