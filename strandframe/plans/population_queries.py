"""Distance and population queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import popgen as pg
from .bridge import view, with_
from .registry import query

_CELLS = "WITH cells AS (SELECT ord, i, substr(seq, i, 1) AS b FROM (SELECT ord, seq, unnest(range(1, length(seq) + 1)) AS i FROM aligned))"


@query("DIST01_prop_dis", with_("aligned", f"{_CELLS} SELECT x.ord AS i, y.ord AS j, round(avg(CASE WHEN x.b <> y.b THEN 1.0 ELSE 0.0 END), 6) AS d FROM cells x JOIN cells y ON x.i = y.i AND x.ord < y.ord GROUP BY 1, 2"))
def _(s, d):
    return pg.sequence_distance(view(s, d, "aligned"), digits=6)


@query("DIST02_pwdist_gaps", with_("aligned", f"{_CELLS} SELECT x.ord AS i, y.ord AS j, round(avg(CASE WHEN x.b <> y.b THEN 1.0 ELSE 0.0 END), 6) AS d FROM cells x JOIN cells y ON x.i = y.i AND x.ord < y.ord WHERE x.b <> '-' AND y.b <> '-' GROUP BY 1, 2"))
def _(s, d):
    return pg.sequence_distance(view(s, d, "aligned"), skip_gaps=True, digits=6).filter("d IS NOT NULL")


_PAIRS = "pairs AS (SELECT x.sample_id AS i, y.sample_id AS j, count(*) FILTER (WHERE x.nalt <> y.nalt) AS diff, count(*) AS n FROM geno x JOIN geno y ON x.pos = y.pos AND x.sample_id < y.sample_id WHERE x.nalt >= 0 AND y.nalt >= 0 GROUP BY 1, 2)"


@query("DIST03_genotype_distance", with_("geno", f"WITH {_PAIRS} SELECT i, j, round(diff / n, 6) AS d FROM pairs"))
def _(s, d):
    return pg.genotype_distance(view(s, d, "geno"), digits=6).filter("n > 0").select("i", "j", "d")


@query("DIST04_packed", with_("geno", f"WITH {_PAIRS} SELECT i, j, diff, n, n * n + diff AS code FROM pairs"))
def _(s, d):
    p = pg.genotype_distance(view(s, d, "geno")).filter("n > 0").withColumn("code", pg.packed(F.col("diff"), F.col("n")))
    back = pg.unpacked(F.col("code"))
    return p.select("i", "j", back["diff"].alias("diff"), back["n"].alias("n"), "code")


_DXY = f"""WITH {_PAIRS}, dist AS (SELECT i, j, diff / n AS d FROM pairs), w AS (SELECT a.pop AS g1, b.pop AS g2, d FROM dist JOIN samples a ON i = a.sample_id JOIN samples b ON j = b.sample_id),
  both_ AS (SELECT * FROM w UNION ALL SELECT g2, g1, d FROM w UNION ALL SELECT pop, pop, 0.0 FROM samples), x AS (SELECT g1, g2, avg(d) AS dxy FROM both_ GROUP BY g1, g2)"""


def _dxy(s, d):
    groups = view(s, d, "samples").select("sample_id", F.col("pop").alias("grp"))
    return pg.genotype_dxy(view(s, d, "geno"), groups)


@query("DIST05_dxy", with_("geno samples", f"{_DXY} SELECT g1, g2, round(dxy, 6) AS dxy FROM x"))
def _(s, d):
    return _dxy(s, d).withColumn("dxy", F.round("dxy", 6))


@query("DIST06_da", with_("geno samples", f"{_DXY} SELECT x.g1, x.g2, round(x.dxy - (a.dxy + b.dxy) / 2, 6) AS da FROM x JOIN x a ON a.g1 = x.g1 AND a.g2 = x.g1 JOIN x b ON b.g1 = x.g2 AND b.g2 = x.g2"))
def _(s, d):
    return pg.da(_dxy(s, d)).withColumn("da", F.round("da", 6))


_COUNTS = "WITH c AS (SELECT pop AS grp, pos, CAST(sum(2 - nalt) AS BIGINT) AS n0, CAST(sum(nalt) AS BIGINT) AS n1 FROM geno JOIN samples USING (sample_id) WHERE nalt >= 0 GROUP BY pop, pos)"


def _counts(s, d):
    return pg.population_counts(view(s, d, "geno"), view(s, d, "samples").select("sample_id", F.col("pop").alias("grp")))


@query("POP01_population_counts", with_("geno samples", f"{_COUNTS} SELECT grp, pos, n0, n1 FROM c"))
def _(s, d):
    return _counts(s, d)


def fst_sql(a0: str, a1: str, b0: str, b1: str) -> str:
    inner = lambda x, y: f"coalesce(2.0 * {x} * {y} / nullif(({x} + {y}) * ({x} + {y} - 1), 0), 0) / 2"
    between = f"(1 - coalesce(CAST({a0} * {b0} + {a1} * {b1} AS DOUBLE) / nullif(({a0} + {a1}) * ({b0} + {b1}), 0), 1))"
    return f"CASE WHEN {between} = 0 THEN -1 ELSE ({between} - {inner(a0, a1)} - {inner(b0, b1)}) / {between} END"


_SIDES = ", ".join(f"sum(CASE WHEN grp IN ({g}) THEN {c} ELSE 0 END) AS {c}_{i}" for i, g in enumerate(("'ASIA'", "'EUROPE', 'AFRICA'")) for c in ("n0", "n1"))


@query("POP02_hudson_fst", with_("geno samples", f"{_COUNTS}, p AS (SELECT pos, {_SIDES} FROM c GROUP BY pos) SELECT pos, round({fst_sql('n0_0', 'n1_0', 'n0_1', 'n1_1')}, 6) AS fst FROM p"))
def _(s, d):
    return pg.hudson_fst(_counts(s, d), "ASIA", ["EUROPE", "AFRICA"]).withColumn("fst", F.round("fst", 6))


_R2 = """s AS (SELECT x.pos AS p, y.pos AS q, count(*)::DOUBLE AS n, sum(x.nalt)::DOUBLE AS sx, sum(y.nalt)::DOUBLE AS sy, sum(x.nalt * y.nalt)::DOUBLE AS sxy, sum(x.nalt * x.nalt)::DOUBLE AS sxx, sum(y.nalt * y.nalt)::DOUBLE AS syy
  FROM geno x JOIN geno y ON x.sample_id = y.sample_id AND x.pos < y.pos WHERE x.nalt >= 0 AND y.nalt >= 0 GROUP BY 1, 2),
  r AS (SELECT p, q, (n * sxy - sx * sy) * (n * sxy - sx * sy) / nullif((n * sxx - sx * sx) * (n * syy - sy * sy), 0) AS r2 FROM s)"""


@query("POP03_ld", with_("geno", f"WITH {_R2} SELECT p, q, round(r2, 6) AS r2 FROM r"))
def _(s, d):
    return pg.ld(view(s, d, "geno")).withColumn("r2", F.round("r2", 6))


def _pruned(scores: str) -> str:
    """Greedy pruning of scored positions (pos, chrom, score), one after another by rank inside each chromosome."""
    return f"""WITH RECURSIVE {_R2}, scored AS ({scores}), ranked AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY score DESC, pos) AS rank FROM scored WHERE pos IN (SELECT pos FROM geno WHERE nalt >= 0)),
  near AS (SELECT p AS x, q AS y FROM r WHERE r2 >= 0.1 UNION ALL SELECT q, p FROM r WHERE r2 >= 0.1), of_ AS (SELECT chrom, rank, pos, coalesce(list(y) FILTER (WHERE y IS NOT NULL), []) AS ys FROM ranked LEFT JOIN near ON x = pos GROUP BY chrom, rank, pos),
  g AS (SELECT DISTINCT chrom, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept FROM ranked UNION ALL SELECT g.chrom, o.rank, CASE WHEN list_has_any(g.kept, o.ys) THEN g.kept ELSE list_append(g.kept, o.pos) END FROM g JOIN of_ o ON o.chrom = g.chrom AND o.rank = g.rank + 1)
  SELECT chrom, unnest(kept) AS pos FROM (SELECT chrom, arg_max(kept, rank) AS kept FROM g GROUP BY chrom)"""


_MAC = "SELECT pos, least(count(*) FILTER (WHERE nalt < 0.5), count(*) FILTER (WHERE nalt >= 0.5)) AS mac FROM geno WHERE nalt >= 0 GROUP BY pos"


@query("POP04_ld_pruning", with_("geno variants", _pruned(f"SELECT pos, chrom, mac AS score FROM ({_MAC}) m JOIN variants USING (pos)")))
def _(s, d):
    from ..operators.qc import allele_counts

    g = view(s, d, "geno")
    scores = allele_counts(g, strict=True).join(view(s, d, "variants").select("pos", "chrom"), "pos").select("pos", "chrom", F.col("mac").alias("score"))
    return pg.prune(g, scores, r2=0.1)


@query("POP05_weighted_pruning", with_("geno variants genes", _pruned(f"SELECT v.pos, v.chrom, mac * CASE WHEN v.pos IN (SELECT w.pos FROM variants w JOIN genes g ON w.chrom = g.chrom AND w.pos BETWEEN start_pos AND end_pos) THEN 2.0 ELSE 1.0 END AS score FROM ({_MAC}) m JOIN variants v USING (pos)")))
def _(s, d):
    from ..operators.positions import in_intervals
    from ..operators.qc import allele_counts

    v = view(s, d, "variants").select("pos", "chrom")
    coding = in_intervals(v, view(s, d, "genes")).select("pos").distinct().withColumn("cds", F.lit(1))
    mac = allele_counts(view(s, d, "geno"), strict=True)
    scores = v.join(mac, "pos").join(coding, "pos", "left").select("pos", "chrom", (F.col("mac") * F.when(F.col("cds") == 1, 2.0).otherwise(1.0)).alias("score"))
    return pg.prune(view(s, d, "geno"), scores, r2=0.1)


@query("POP06_pca")
def _(s, d):
    df = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    out, _ = pg.pca(df, "embedding", 3)
    return out.select("vec_id", F.transform("pc", lambda x: F.round(F.abs(x), 4)).alias("pc"))


_EVEN = "(CAST('0x' || substr(md5('1:s_acctbal:' || s_suppkey), {}, 8) AS BIGINT) + 0.5) / 4294967296.0"


@query("POP07_jitter", f"SELECT s_suppkey, round(s_acctbal + sqrt(-2 * ln({_EVEN.format(1)})) * cos(2 * pi() * {_EVEN.format(9)}) * 0.01 * (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 6) AS s_acctbal FROM supplier")
def _(s, d):
    return pg.jitter(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal"), ["s_acctbal"], key="s_suppkey").withColumn("s_acctbal", F.round("s_acctbal", 6))


@query("POP08_missingness", with_("geno", "SELECT sample_id, round(count(*) FILTER (WHERE nalt < 0) / count(*), 6) AS f_missing FROM geno GROUP BY sample_id"))
def _(s, d):
    return view(s, d, "geno").groupBy("sample_id").agg(F.round(F.count_if(F.col("nalt") < 0) / F.count("*"), 6).alias("f_missing"))


_TREE = """WITH leaves AS (SELECT s_suppkey AS leaf, s_nationkey AS nk, n_regionkey AS rk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  t AS (SELECT leaf, 'n' || nk AS ancestor, 1.0 + leaf % 3 AS dist FROM leaves UNION ALL SELECT leaf, 'r' || rk, 3.0 + leaf % 3 FROM leaves UNION ALL SELECT leaf, 'root', 6.0 + leaf % 3 FROM leaves),
  p AS (SELECT a.leaf AS i, b.leaf AS j, CAST(min(a.dist + b.dist) AS DOUBLE) AS d FROM t a JOIN t b ON a.ancestor = b.ancestor AND a.leaf < b.leaf GROUP BY 1, 2)"""


def _leaves(s, d):
    leaf = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    far = F.col("s_suppkey") % 3
    ways = F.array(*[F.struct(a.alias("ancestor"), (F.lit(x) + far).cast("double").alias("dist")) for a, x in ((F.concat(F.lit("n"), "s_nationkey"), 1.0), (F.concat(F.lit("r"), "n_regionkey"), 3.0), (F.lit("root"), 6.0))])
    return leaf.select(F.col("s_suppkey").alias("leaf"), F.explode(ways).alias("w")).select("leaf", "w.ancestor", "w.dist")


@query("DIST07_patristic", f"{_TREE} SELECT i, j, d FROM p")
def _(s, d):
    return pg.patristic(_leaves(s, d))


@query("SRT03_nearest_taxa", f"{_TREE}, both_ AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p) SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM both_) WHERE k <= 5")
def _(s, d):
    return pg.nearest(_leaves(s, d), 5)
