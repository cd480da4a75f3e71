"""Allele call, filter and quality queries over the calls, geno and variants views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as ca, qc
from .bridge import view, with_
from .registry import query

CV = "calls variants"
def _ad():
    return F.array("ad0", "ad1", "ad2")


def _alleles():
    return F.array("ref", "alt1", "alt2")


def _cv(s, d):
    return view(s, d, "calls").join(view(s, d, "variants"), "pos")


def _sql(het: str = "or", hetratio: float = 0.67, minalt: int = 2) -> str:
    """CTE called(sample_id, pos, chrom, ref, alt1, alt2, idx, failed, het)."""
    het_test = "false" if hetratio < 0 else f"(hi / total < {hetratio} {het} total - hi >= {minalt})"
    return f"""WITH raw AS (SELECT *, greatest(ad0, ad1, ad2) AS hi, ad0 + ad1 + ad2 + CAST(0.001 AS DOUBLE) AS total FROM calls JOIN variants USING (pos)),
      called AS (SELECT sample_id, pos, chrom, ref, alt1, alt2, mhapidx, CASE WHEN ad0 = hi THEN 0 WHEN ad1 = hi THEN 1 ELSE 2 END AS idx, total < 5 AS failed, {het_test} AS het FROM raw),
      letters AS (SELECT *, CASE WHEN failed THEN 'X' WHEN het THEN 'N' WHEN idx = 0 THEN ref WHEN idx = 1 THEN alt1 ELSE alt2 END AS allele FROM called)"""


def _letters(s, d, **kw):
    return _cv(s, d).withColumn("allele", ca.barcode(ca.call(_ad(), **kw), _alleles()))


@query("CALL01_call_or", with_(CV, f"{_sql()} SELECT sample_id, pos, CAST(idx AS INT) AS idx, failed, het FROM called"))
def _(s, d):
    c = ca.call(_ad())
    return _cv(s, d).select("sample_id", "pos", c["idx"].alias("idx"), c["failed"].alias("failed"), c["het"].alias("het"))


@query("CALL02_call_and", with_(CV, f"{_sql('and')} SELECT sample_id, pos, CAST(idx AS INT) AS idx, failed, het FROM called"))
def _(s, d):
    c = ca.call(_ad(), het_rule="and")
    return _cv(s, d).select("sample_id", "pos", c["idx"].alias("idx"), c["failed"].alias("failed"), c["het"].alias("het"))


@query("CALL02_genotype_mode", with_("geno", "SELECT sample_id, pos, CAST(CASE WHEN nalt = 2 THEN 1 ELSE greatest(nalt, 0) END AS INT) AS idx, nalt < 0 AS failed, nalt = 1 AS het FROM geno"))
def _(s, d):
    gt = F.when(F.col("nalt") < 0, F.array(F.lit(-1), F.lit(-1))).when(F.col("nalt") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("nalt") / 2).cast("int"), (F.col("nalt") / 2).cast("int")))
    c = ca.genotype_call(gt)
    return view(s, d, "geno").select("sample_id", "pos", c["idx"].alias("idx"), c["failed"].alias("failed"), c["het"].alias("het"))


@query("CALL03_barcode", with_(CV, f"{_sql()} SELECT sample_id, string_agg(allele, '' ORDER BY pos) AS barcode, count(*) FILTER (WHERE allele = 'X') AS n_failed, count(*) FILTER (WHERE allele = 'N') AS n_het FROM letters GROUP BY sample_id"))
def _(s, d):
    c = _letters(s, d)
    counts = c.groupBy("sample_id").agg(F.count_if(F.col("allele") == "X").alias("n_failed"), F.count_if(F.col("allele") == "N").alias("n_het"))
    return ca.ordered(c, ["sample_id"], "pos", F.col("allele"), "barcode").join(counts, "sample_id")


@query("CALL04_realmccoil", with_(CV, f"{_sql()} SELECT sample_id, pos, CAST(CASE WHEN failed THEN -1 WHEN het THEN 0.5 ELSE least(idx, 1) END AS DOUBLE) AS code FROM called"))
def _(s, d):
    return _cv(s, d).select("sample_id", "pos", ca.realmccoil(ca.call(_ad())).alias("code"))


@query("CALL05_hmmibd", with_(CV, f"{_sql(hetratio=-1)} SELECT sample_id, pos, CAST(CASE WHEN failed THEN -1 ELSE idx END AS INT) AS code FROM called"))
def _(s, d):
    return _cv(s, d).select("sample_id", "pos", ca.hmmibd(ca.call(_ad(), hetratio=-1, minaltdepth=-1)).alias("code"))


@query("CALL06_major_allele", with_(CV, f"{_sql(hetratio=-1)} SELECT sample_id, pos, allele FROM letters"))
def _(s, d):
    return _letters(s, d, hetratio=-1, minaltdepth=-1).select("sample_id", "pos", "allele")


@query("CALL07_wide_table", with_(CV, f"{_sql()} SELECT sample_id, " + ", ".join(f"max(CASE WHEN chrom || ':' || pos = '{p}' THEN allele END) AS \"{p}\"" for p in ("chr1:0", "chr1:1", "chr1:49", "chr2:50", "chr4:199")) + " FROM letters GROUP BY sample_id"))
def _(s, d):
    df = _letters(s, d).withColumn("pos_id", F.concat_ws(":", "chrom", "pos"))
    return ca.wide(df, ["chr1:0", "chr1:1", "chr1:49", "chr2:50", "chr4:199"])


@query("CALL08_ralt", with_("calls", "SELECT sample_id, pos, CASE WHEN ad0 + ad1 < 5 THEN -1 ELSE round(ad0 / CAST(ad0 + ad1 AS DOUBLE), 6) END AS ratio, least(ad0, ad1) AS minor, ad0 + ad1 AS depth FROM calls"))
def _(s, d):
    r = ca.ralt(F.col("ad0"), F.col("ad1"))
    return view(s, d, "calls").select("sample_id", "pos", F.round(r["ratio"], 6).alias("ratio"), r["minor"].alias("minor"), r["depth"].alias("depth"))


@query("CALL09_nalt", with_("calls", """SELECT sample_id, pos, CAST(CASE WHEN r < 0 THEN -1 WHEN r > 0.5 THEN 2 ELSE 0 END AS INT) AS majority, CAST(CASE WHEN r < 0 THEN -1 WHEN r > 0.25 AND r < 0.75 THEN 1 WHEN r < 0.5 THEN 0 ELSE 2 END AS INT) AS band,
  CAST(CASE WHEN r < 0 THEN -1 WHEN r > 0.25 AND r < 0.75 AND m > 3 THEN 1 WHEN r < 0.5 THEN 0 ELSE 2 END AS INT) AS deep FROM (SELECT sample_id, pos, CASE WHEN ad0 + ad1 < 5 THEN -1 ELSE ad0 / CAST(ad0 + ad1 AS DOUBLE) END AS r, least(ad0, ad1) AS m FROM calls)"""))  # fmt: skip
def _(s, d):
    r = ca.ralt(F.col("ad0"), F.col("ad1"))
    v = view(s, d, "calls").select("sample_id", "pos", r["ratio"].alias("r"), r["minor"].alias("m"))
    kinds = {"majority": {}, "band": {"threshold": 0.25}, "deep": {"threshold": 0.25, "minmdp": 3}}
    return v.select("sample_id", "pos", *[ca.nalt(F.col("r"), F.col("m"), **kw).alias(k) for k, kw in kinds.items()])


@query("CALL11_recode", with_("geno", "SELECT sample_id, pos, CASE nalt WHEN 0 THEN [0, 0] WHEN 2 THEN [1, 1] WHEN 1 THEN [0, 1] ELSE [-1, -1] END AS diploid, CASE nalt WHEN 0 THEN [0] WHEN 2 THEN [2] ELSE [1] END AS haploid_na FROM geno"))
def _(s, d):
    code = F.col("nalt").cast("string")
    return view(s, d, "geno").select("sample_id", "pos", ca.recode(code, ca.DIPLOID).alias("diploid"), ca.recode(code, ca.HAPLOID_NA).alias("haploid_na"))


@query("CALL12_haplotypes", with_("geno", "SELECT sample_id, string_agg(CASE nalt WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '-' END, '' ORDER BY pos) AS haplotype FROM geno GROUP BY sample_id"))
def _(s, d):
    return ca.ordered(view(s, d, "geno"), ["sample_id"], "pos", F.substring(F.col("nalt").cast("string"), 1, 1), "haplotype")


@query("CALL13_depth_index", with_("calls", "SELECT sample_id, pos, CAST(CASE WHEN ad0 + ad1 + ad2 < 5 THEN 255 WHEN ad0 = greatest(ad0, ad1, ad2) THEN 0 WHEN ad1 = greatest(ad0, ad1, ad2) THEN 1 ELSE 2 END AS INT) AS code FROM calls"))
def _(s, d):
    return view(s, d, "calls").select("sample_id", "pos", ca.depth_index(_ad()).alias("code"))


@query("CALL14_dense_codes", "SELECT n_nationkey, n_name, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 255 ELSE dense_rank() OVER (PARTITION BY n_nationkey % 5 = 0 ORDER BY substr(n_name, 1, 1)) END AS INT) AS code FROM nation")
def _(s, d):
    t = s.read.parquet(f"{d}/nation.parquet").withColumn("letter", F.when(F.col("n_nationkey") % 5 != 0, F.substring("n_name", 1, 1)))
    return ca.dense_codes(t, "letter").select("n_nationkey", "n_name", "code")


_MHAP = f"""{_sql()}, codes AS (SELECT pos, chrom, chrom || ':' || mhapidx AS code FROM variants), want AS (SELECT code, count(*) AS w FROM codes GROUP BY code),
  m AS (SELECT sample_id, code, string_agg(allele, '' ORDER BY pos) AS h, count(*) AS n FROM letters JOIN codes USING (chrom, pos) GROUP BY sample_id, code),
  mh AS (SELECT sample_id, code, CASE WHEN n < w OR contains(h, 'X') THEN 'X' WHEN contains(h, 'N') THEN 'N' ELSE h END AS mhap FROM m JOIN want USING (code))"""


def _mhaps(s, d):
    codes = view(s, d, "variants").select("pos", "chrom", F.concat_ws(":", "chrom", "mhapidx").alias("code"))
    return ca.microhaplotypes(_letters(s, d).select("sample_id", "chrom", "pos", "allele"), codes)


@query("CALL15_microhaplotypes", with_(CV, f"{_MHAP} SELECT sample_id, code, mhap FROM mh"))
def _(s, d):
    return _mhaps(s, d)


@query("CALL15_microhaplotype_counts", with_(CV, f"{_MHAP} SELECT code, count(*) FILTER (WHERE mhap = 'X') AS missing, count(*) FILTER (WHERE mhap = 'N') AS het FROM mh GROUP BY code"))
def _(s, d):
    return ca.microhaplotype_counts(_mhaps(s, d))


@query("CALL17_numeric_haplotypes", with_(CV, f"""{_MHAP}, f AS (SELECT code, mhap, count(*) AS n FROM mh WHERE mhap <> 'X' GROUP BY code, mhap), r AS (SELECT code, mhap, row_number() OVER (PARTITION BY code ORDER BY n DESC, mhap) AS k FROM f)
  SELECT sample_id, code, mhap, CAST(coalesce(k, 0) AS INT) AS code_no FROM mh LEFT JOIN r USING (code, mhap)"""))  # fmt: skip
def _(s, d):
    return ca.numerics(_mhaps(s, d)).select("sample_id", "code", "mhap", "code_no")


@query("SNK11_barcode_text", with_(CV, f"{_sql()} SELECT string_agg(allele, '' ORDER BY pos) || chr(9) || sample_id AS value FROM letters GROUP BY sample_id"))
def _(s, d):
    return ca.ordered(_letters(s, d), ["sample_id"], "pos", F.col("allele"), "b").select(F.concat_ws("\t", "b", F.col("sample_id").cast("string")).alias("value"))


@query("FIL05_chroms", with_("variants", "SELECT pos FROM variants WHERE chrom IN ('chr1', 'chr3')"))
def _(s, d):
    return ca.filter_chroms(view(s, d, "variants"), ["chr1", "chr3"]).select("pos")


@query("FIL06_filter_keywords", with_("variants", "SELECT pos FROM variants WHERE pos % 3 <> 0"))
def _(s, d):
    v = view(s, d, "variants").withColumn("filter", F.when(F.col("pos") % 3 == 0, "PASS;LowQual").when(F.col("pos") % 3 == 1, "PASS"))
    return ca.exclude_keywords(v, ["LowQual", "q10"]).select("pos")


@query("FIL07_no_indels", with_("variants", "SELECT pos FROM variants WHERE pos % 4 <> 0"))
def _(s, d):
    v = view(s, d, "variants").withColumn("alts", F.array("alt1", F.when(F.col("pos") % 4 == 0, F.concat("alt2", "ref")).otherwise(F.col("alt2"))))
    return ca.no_indels(v).select("pos")


_STAT = """WITH n AS (SELECT count(*) AS n FROM supplier), st AS (SELECT pos, n, count(*) FILTER (WHERE nalt = 0) AS r, count(*) FILTER (WHERE nalt = 1) AS h, count(*) FILTER (WHERE nalt = 2) AS a FROM geno, n GROUP BY pos, n),
  v AS (SELECT *, n - r - h - a AS m, 2 * r + h AS n0, 2 * a + h AS n1 FROM st)"""


def _n(s, d) -> int:
    return s.read.parquet(f"{d}/supplier.parquet").count()


for _id, _kw, _where in (
    ("FIL08_missing", {"missing": 0.15}, "NOT (m / n >= 0.15)"),
    ("FIL09_het", {"het": 0.4}, "NOT ((h + m) / n >= 0.4)"),
    ("FIL09_het_strict", {"het": 0.25, "strict_het": True}, "NOT (h / n >= 0.25)"),
    ("FIL10_mac", {"mac": 70}, "NOT (least(n0, n1) < 70)"),
    ("FIL11_maf", {"maf": 0.45}, "NOT (1 - greatest(n0, n1) / (n0 + n1) < 0.45)"),
):

    @query(_id, with_("geno", f"{_STAT} SELECT pos FROM v WHERE {_where}"))
    def _(s, d, kw=_kw):
        return ca.kept_variants(view(s, d, "geno"), _n(s, d), **kw)


@query("FIL12_redetermine", with_("calls", """SELECT sample_id, pos, CASE WHEN ad0 + ad1 + ad2 < 5 THEN './.' WHEN len(x) = 1 THEN x[1] || '/' || x[1] WHEN len(x) >= 2 THEN x[1] || '/' || x[2] ELSE '0/0' END AS gt
  FROM (SELECT *, list_filter(list_value(CASE WHEN ad0 >= 2 THEN 0 END, CASE WHEN ad1 >= 2 THEN 1 END, CASE WHEN ad2 >= 2 THEN 2 END), lambda i: i IS NOT NULL) AS x FROM calls)"""))  # fmt: skip
def _(s, d):
    return view(s, d, "calls").select("sample_id", "pos", ca.redetermine(_ad(), F.lit("0/0")).alias("gt"))


@query("FIL13_haplotype_sequences", with_("geno variants", "SELECT sample_id, string_agg(CASE nalt WHEN 0 THEN ref WHEN 2 THEN alt1 ELSE 'N' END, '' ORDER BY pos) AS seq FROM geno JOIN variants USING (pos) GROUP BY sample_id"))
def _(s, d):
    return ca.haplotype_sequences(view(s, d, "geno").join(view(s, d, "variants"), "pos"))


@query("FIL14_sample_subset", with_("geno samples", "SELECT sample_id, pos, nalt FROM geno SEMI JOIN (SELECT sample_id FROM samples WHERE pop = 'ASIA') w USING (sample_id)"))
def _(s, d):
    return ca.subset(view(s, d, "geno"), view(s, d, "samples").filter("pop = 'ASIA'").select("sample_id"), "sample_id")


@query("FIL15_duplicate_positions", with_("pos_a pos_b", "SELECT chrom, pos, count(*) AS n FROM (SELECT * FROM pos_a UNION ALL SELECT * FROM pos_b) GROUP BY chrom, pos HAVING count(*) > 1"))
def _(s, d):
    return ca.duplicate_positions(view(s, d, "pos_a").unionByName(view(s, d, "pos_b")))


@query("FIL16_complete_variants", with_("calls samples", "SELECT pos FROM (SELECT country, pos, sum(ad0 + ad1) AS dp FROM calls JOIN samples USING (sample_id) GROUP BY country, pos) GROUP BY pos HAVING count(*) FILTER (WHERE dp >= 30) = (SELECT count(DISTINCT country) FROM samples)"))
def _(s, d):
    who = view(s, d, "samples").select("sample_id", "country")
    c = view(s, d, "calls").join(who, "sample_id").groupBy("country", "pos").agg(F.sum("ad0").alias("ad0"), F.sum("ad1").alias("ad1"))
    return ca.complete(c, who.select("country").distinct().count(), of="pos", mindepth=30)


@query("FIL17_position_subset", with_("geno pos_b", "SELECT sample_id, pos, nalt FROM geno WHERE pos IN (SELECT pos FROM pos_b WHERE chrom = 'A')"))
def _(s, d):
    return ca.subset(view(s, d, "geno"), view(s, d, "pos_b").filter("chrom = 'A'").select("pos"), "pos")


@query("FIL18_included_positions", with_("variants genes", "SELECT pos FROM variants WHERE chrom || ':' || pos IN (SELECT chrom || ':' || start_pos FROM genes)"))
def _(s, d):
    keys = view(s, d, "genes").select(F.concat_ws(":", "chrom", "start_pos").alias("k"))
    return ca.subset(view(s, d, "variants").withColumn("k", F.concat_ws(":", "chrom", "pos")), keys, "k").select("pos")


@query("FIL19_set_missing", with_("variants", "SELECT pos, CASE WHEN ref NOT IN ('A', 'T') THEN ref END AS ref FROM variants"))
def _(s, d):
    return view(s, d, "variants").select("pos", ca.set_missing(F.col("ref"), ["A", "T"]).alias("ref"))


def _classes(by: str, n: str) -> str:
    cols = "homref, hets, homalt, miss".split(", ")
    return f"WITH c AS (SELECT {by}, n, count(*) FILTER (WHERE nalt = 0) AS homref, count(*) FILTER (WHERE nalt = 1) AS hets, count(*) FILTER (WHERE nalt = 2) AS homalt FROM geno, ({n}) n GROUP BY {by}, n), e AS (SELECT *, n - homref - hets - homalt AS miss FROM c) SELECT {by}, homref, hets, homalt, miss, " + ", ".join(f"round({x} / n, 6) AS f_{x}" for x in cols) + " FROM e"


@query("AGG11_variant_qc", with_("geno", _classes("pos", "SELECT count(*) AS n FROM supplier")))
def _(s, d):
    return qc.genotype_classes(view(s, d, "geno"), "pos", _n(s, d))


@query("AGG11_sample_qc", with_("geno", _classes("sample_id", "SELECT count(DISTINCT l_partkey % 200) AS n FROM lineitem")))
def _(s, d):
    return qc.genotype_classes(view(s, d, "geno"), "sample_id", view(s, d, "variants").count())


@query("AGG12_depth_missingness", with_("calls", "SELECT pos, missing, round(missing / n, 6) AS f_missing FROM (SELECT pos, n, n - count(*) FILTER (WHERE ad0 + ad1 >= 5) AS missing FROM calls, (SELECT count(*) AS n FROM supplier) GROUP BY pos, n)"))
def _(s, d):
    return qc.depth_missingness(view(s, d, "calls"), "pos", _n(s, d))


@query("AGG13_allele_counts", with_("geno", "SELECT pos, a0 AS allele_0, a1 AS allele_1, least(a0, a1) AS mac FROM (SELECT pos, count(*) FILTER (WHERE nalt < 0.5) AS a0, count(*) FILTER (WHERE nalt >= 0.5) AS a1 FROM geno GROUP BY pos)"))
def _(s, d):
    return qc.allele_counts(view(s, d, "geno"))


_COUNTS = "WITH t AS (SELECT pos, sum(ad0) AS c0, sum(ad1) AS c1, sum(ad2) AS c2 FROM calls GROUP BY pos), v AS (SELECT pos, chrom, ref, alt1, CASE WHEN pos % 4 = 0 THEN alt2 || ref ELSE alt2 END AS alt2 FROM variants), a AS (SELECT * FROM t JOIN v USING (pos))"


def _stats(s, d):
    t = view(s, d, "calls").groupBy("pos").agg(F.array(F.sum("ad0"), F.sum("ad1"), F.sum("ad2")).alias("counts"))
    v = view(s, d, "variants").select("pos", F.array("ref", "alt1", F.when(F.col("pos") % 4 == 0, F.concat("alt2", "ref")).otherwise(F.col("alt2"))).alias("alleles"))
    return qc.variant_stats(t.join(v, "pos"))


@query("AGG14_allele_lengths", with_(CV, f"{_COUNTS} SELECT pos, CAST(length(alt2) AS INT) AS last_length, CAST((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT AS INT) AS tally FROM a"))
def _(s, d):
    return _stats(s, d).select("pos", F.get("lengths", 2).alias("last_length"), "tally")


@query("AGG15_biallelic_ratio", with_(CV, f"{_COUNTS} SELECT pos, round((c0 + c1 + c2 - least(c0, c1, c2)) / (c0 + c1 + c2), 6) AS ratio, (c0 + c1 + c2 - least(c0, c1, c2)) / (c0 + c1 + c2) >= 0.9 AS flag FROM a"))
def _(s, d):
    return _stats(s, d).select("pos", F.round("biallelic", 6).alias("ratio"), F.col("is_biallelic").alias("flag"))


@query("AGG16_indel_ratio", with_(CV, f"{_COUNTS} SELECT pos, round(CASE WHEN length(alt2) > 1 THEN c2 ELSE 0 END / (c0 + c1 + c2), 6) AS ratio FROM a"))
def _(s, d):
    return _stats(s, d).select("pos", F.round("indel", 6).alias("ratio"))


@query("AGG17_variant_stats", with_(CV, f"{_COUNTS} SELECT pos, CAST((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT AS INT) AS tally, round((c0 + c1 + c2 - least(c0, c1, c2)) / (c0 + c1 + c2), 6) AS biallelic, round(CASE WHEN length(alt2) > 1 THEN c2 ELSE 0 END / (c0 + c1 + c2), 6) AS indel FROM a"))
def _(s, d):
    return _stats(s, d).select("pos", "tally", F.round("biallelic", 6).alias("biallelic"), F.round("indel", 6).alias("indel"))


@query("AGG18_factorise", with_("seqs", "SELECT doc_id, dense_rank() OVER (ORDER BY f) - 1 AS hap_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY seq) AS f FROM seqs)"))
def _(s, d):
    return ca.factorise(view(s, d, "seqs").select("doc_id", "seq"), "seq", "doc_id").select("doc_id", "hap_id")
