"""Assignment model, selection and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as am
from . import population_queries as pq
from .bridge import view, with_
from .registry import query

GS = "geno samples"
TREE = [["AFRICA", "EUROPE"], ["ASIA", ["AMERICA", "MIDDLE EAST"]]]


def _groups(s, d):
    return view(s, d, "samples").select("sample_id", F.col("pop").alias("grp"))


def _fit_sql(prior: float = 0.1) -> str:
    return f"""WITH c AS (SELECT pop AS grp, pos, sum(2 - nalt) + {prior}::DOUBLE AS r, sum(nalt) + {prior}::DOUBLE AS a FROM geno JOIN samples USING (sample_id) WHERE nalt >= 0 GROUP BY pop, pos),
      prof AS (SELECT grp, pos, ln(r / (r + a)) AS log_ref, ln(a / (r + a)) AS log_alt FROM c),
      lk AS (SELECT sample_id, grp, round(sum((2 - nalt) * log_ref + nalt * log_alt), 6) AS loglk FROM geno JOIN prof USING (pos) WHERE nalt >= 0 GROUP BY sample_id, grp),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY loglk DESC, grp) AS k FROM lk)"""


def _lk(s, d, **kw):
    g = view(s, d, "geno")
    return am.likelihood(g, am.fit(g, _groups(s, d), **kw))


@query("MOD01_profile", with_(GS, f"{_fit_sql()} SELECT grp, pos, round(log_ref, 6) AS log_ref, round(log_alt, 6) AS log_alt FROM prof"))
def _(s, d):
    return am.fit(view(s, d, "geno"), _groups(s, d)).select("grp", "pos", F.round("log_ref", 6).alias("log_ref"), F.round("log_alt", 6).alias("log_alt"))


@query("MOD02_likelihood", with_(GS, f"{_fit_sql()} SELECT sample_id, grp, round(loglk, 3) AS loglk FROM lk"))
def _(s, d):
    return _lk(s, d).withColumn("loglk", F.round("loglk", 3))


@query("MOD03_predict", with_(GS, f"{_fit_sql()} SELECT sample_id, grp AS pred FROM ranked WHERE k = 1"))
def _(s, d):
    return am.predict(_lk(s, d))


@query("MOD04_top_groups", with_(GS, f"{_fit_sql()}, t AS (SELECT sample_id, k, grp, exp(loglk - max(loglk) OVER (PARTITION BY sample_id)) AS o FROM ranked WHERE k <= 3) SELECT sample_id, CAST(k AS INT) AS rank, grp, round(o / sum(o) OVER (PARTITION BY sample_id), 4) AS prob FROM t"))
def _(s, d):
    return am.top_groups(_lk(s, d)).withColumn("prob", F.round("prob", 4))


@query("MOD05_old_prior", with_(GS, f"{_fit_sql(0.001)} SELECT sample_id, grp AS pred FROM ranked WHERE k = 1"))
def _(s, d):
    return am.predict(_lk(s, d, prior=0.001))


@query("AGG19_group_counts", with_(GS, "SELECT pop AS grp, pos, CAST(sum(2 - nalt) AS BIGINT) AS n0, CAST(sum(nalt) AS BIGINT) AS n1 FROM geno JOIN samples USING (sample_id) WHERE nalt >= 0 GROUP BY pop, pos"))
def _(s, d):
    return pq._counts(s, d)


_HAPS = """WITH h AS (SELECT sample_id, chrom AS region, string_agg(nalt, '' ORDER BY pos) AS hap FROM geno JOIN variants USING (pos) WHERE nalt >= 0 GROUP BY sample_id, chrom), g AS (SELECT h.*, pop AS grp FROM h JOIN samples USING (sample_id)),
  kinds AS (SELECT DISTINCT region, hap FROM g), m AS (SELECT region, count(*) AS m FROM kinds GROUP BY region), own AS (SELECT region, grp, count(*) AS n FROM g GROUP BY region, grp),
  p AS (SELECT own.region, own.grp, kinds.hap, ln((coalesce(k, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * m)) AS logp FROM own JOIN kinds USING (region) JOIN m USING (region) LEFT JOIN (SELECT region, grp, hap, count(*) AS k FROM g GROUP BY ALL) s ON s.region = own.region AND s.grp = own.grp AND s.hap = kinds.hap)"""


@query("MOD06_haplotype_model", with_("geno samples variants", f"{_HAPS} SELECT sample_id, p.grp, round(sum(logp), 2) AS loglk FROM h JOIN p USING (region, hap) GROUP BY sample_id, p.grp"))
def _(s, d):
    from ..operators.calls import ordered

    v = view(s, d, "variants").select("pos", F.col("chrom").alias("region"))
    haps = ordered(view(s, d, "geno").filter("nalt >= 0").join(v, "pos"), ["sample_id", "region"], "pos", F.col("nalt").cast("string"), "hap")
    return am.haplotype_likelihood(haps, am.haplotype_profile(haps, _groups(s, d))).withColumn("loglk", F.round("loglk", 2))


def _positions(s, d) -> list[int]:
    return [r[0] for r in view(s, d, "variants").select("pos").orderBy("pos").collect()]


@query("MOD07_logistic")
def _(s, d):
    return am.classify(view(s, d, "geno"), _groups(s, d), positions=_positions(s, d))


@query("MOD07_naive_bayes", with_(GS, """WITH x AS (SELECT sample_id, pop AS grp, pos, nalt FROM geno JOIN samples USING (sample_id) WHERE nalt >= 0), d AS (SELECT DISTINCT sample_id, grp FROM x), g AS (SELECT grp, count(*) AS n FROM d GROUP BY grp),
  every AS (SELECT DISTINCT pos FROM geno), size AS (SELECT grp, sum(nalt) AS total FROM x GROUP BY grp), cell AS (SELECT grp, pos, sum(nalt) AS k FROM x GROUP BY grp, pos),
  theta AS (SELECT g.grp, e.pos, ln(coalesce(k, 0) + 1.0) - ln(total + CAST((SELECT count(*) FROM every) AS DOUBLE)) AS t FROM g CROSS JOIN every e JOIN size USING (grp) LEFT JOIN cell ON cell.grp = g.grp AND cell.pos = e.pos),
  lk AS (SELECT sample_id, theta.grp, sum(nalt * t) AS l FROM x JOIN theta USING (pos) GROUP BY sample_id, theta.grp),
  best AS (SELECT sample_id, lk.grp, row_number() OVER (PARTITION BY sample_id ORDER BY l + ln(n + 1.0) DESC, lk.grp) AS k FROM lk JOIN g USING (grp))
  SELECT sample_id, grp AS pred FROM best WHERE k = 1"""))  # fmt: skip
def _(s, d):
    return am.classify(view(s, d, "geno"), _groups(s, d), positions=_positions(s, d), model="multinomial")


@query("SEL01_fixed_snps", with_("geno", "SELECT sample_id, pos, nalt FROM geno WHERE pos IN (3, 5, 8, 13, 21, 34, 55, 89, 144)"))
def _(s, d):
    return am.select_snps(view(s, d, "geno"), keep=[3, 5, 8, 13, 21, 34, 55, 89, 144])


@query("SEL01_random_snps", with_("geno", "SELECT sample_id, pos, nalt FROM geno WHERE pos IN (SELECT pos FROM (SELECT DISTINCT pos FROM geno) ORDER BY md5('1:' || pos), pos LIMIT 20)"))
def _(s, d):
    return am.select_snps(view(s, d, "geno"), random=20)


@query("SEL02_tree_snps")
def _(s, d):
    return am.tree_features(view(s, d, "geno"), _groups(s, d), positions=_positions(s, d))


@query("SEL03_forest_snps")
def _(s, d):
    return am.tree_features(view(s, d, "geno"), _groups(s, d), positions=_positions(s, d), forest=True, least=0.01)


_NODES = ", ".join(f"('{n}', '{g}', {i})" for n, left, right in am.tree_nodes(TREE) for i, part in enumerate((left, right)) for g in part)
_FST = f"""{pq._COUNTS}, t(node, grp, side) AS (VALUES {_NODES}), p AS (SELECT node, pos, {', '.join(f'sum(CASE WHEN side = {i} THEN {c} ELSE 0 END) AS {c}_{i}' for i in (0, 1) for c in ('n0', 'n1'))} FROM c JOIN t USING (grp) GROUP BY node, pos),
  f AS (SELECT node, pos, round({pq.fst_sql('n0_0', 'n1_0', 'n0_1', 'n1_1')}, 6) AS fst FROM p)"""


@query("SEL04_hierarchical_fst", with_(GS, f"{_FST} SELECT node, CAST(k AS INT) AS rank, pos, fst FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY fst DESC, pos) AS k FROM f) WHERE k <= 5"))
def _(s, d):
    return am.hierarchical_fst(pq._counts(s, d), TREE, k=5)


@query("SRT05_top_snps", with_(GS, f"{_FST} SELECT pos, fst FROM f WHERE node = 'n' ORDER BY fst DESC, pos LIMIT 10"))
def _(s, d):
    return am.hierarchical_fst(pq._counts(s, d), TREE, k=10).filter("node = 'n'").select("pos", "fst")


@query("SRT04_top_two_groups", with_(GS, f"{_fit_sql()} SELECT sample_id, grp FROM ranked WHERE k <= 2"))
def _(s, d):
    return am.top_groups(_lk(s, d), 2).select("sample_id", "grp")


_MCC = "min(round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / CASE WHEN r = 0 THEN 1e-5 ELSE r END, 6))"


def _least_mcc(pairs: str, by: str) -> str:
    """CTE least: the least MCC of a group in each part of pairs (by, truth, pred)."""
    return f"""labels_ AS (SELECT DISTINCT {by}, truth AS grp FROM {pairs} UNION SELECT DISTINCT {by}, pred FROM {pairs}),
  cells_ AS (SELECT p.{by}, grp, CAST(count(*) FILTER (WHERE truth = grp AND pred = grp) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE truth <> grp AND pred <> grp) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE truth <> grp AND pred = grp) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE truth = grp AND pred <> grp) AS DOUBLE) AS fn FROM {pairs} p JOIN labels_ l ON l.{by} = p.{by} GROUP BY p.{by}, grp),
  least AS (SELECT {by}, {_MCC} AS least FROM (SELECT *, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS r FROM cells_) GROUP BY {by})"""


_REFINED = f"""{_FST}, top_ AS (SELECT pos, row_number() OVER (PARTITION BY node ORDER BY fst DESC, pos) AS rank FROM f), ch AS (SELECT DISTINCT k, pos FROM top_, range(1, 4) ks(k) WHERE rank <= k),
  own AS (SELECT grp, pos, n0 + 0.1::DOUBLE AS r, n1 + 0.1::DOUBLE AS a FROM c),
  lk AS (SELECT k, sample_id, grp, round(sum((2 - nalt) * ln(r / (r + a)) + nalt * ln(a / (r + a))), 6) AS loglk FROM geno JOIN ch USING (pos) JOIN own USING (pos) WHERE nalt >= 0 GROUP BY k, sample_id, grp),
  pr AS (SELECT k, pop AS truth, grp AS pred FROM (SELECT *, row_number() OVER (PARTITION BY k, sample_id ORDER BY loglk DESC, grp) AS j FROM lk) JOIN samples USING (sample_id) WHERE j = 1),
  {_least_mcc('pr', 'k')}, won AS (SELECT coalesce(min(k) FILTER (WHERE least >= 0.75), 3) AS k, bool_or(least >= 0.75) AS reached FROM least)
  SELECT pos, reached FROM ch JOIN won USING (k)"""


@query("SEL05_refined_snps", with_(GS, _REFINED))
def _(s, d):
    return am.refine(view(s, d, "geno"), _groups(s, d), pq._counts(s, d), TREE, max_iter=3)


@query("SEL06_guide_tree", f"SELECT node, CAST(count(*) FILTER (WHERE side = 0) AS BIGINT) AS n_left, CAST(count(*) FILTER (WHERE side = 1) AS BIGINT) AS n_right FROM (VALUES {_NODES}) t(node, grp, side) GROUP BY node")
def _(s, d):
    rows = [(n, len(a), len(b)) for n, a, b in am.tree_nodes(TREE)]
    return s.createDataFrame(rows, "node string, n_left long, n_right long")


_SCORES = """WITH p AS (SELECT CAST(truth AS VARCHAR) AS truth, CAST(pred AS VARCHAR) AS pred FROM preds), l AS (SELECT truth AS grp FROM p UNION SELECT pred FROM p),
  c AS (SELECT grp, count(*) FILTER (WHERE truth = grp AND pred = grp) AS tp, count(*) FILTER (WHERE truth <> grp AND pred <> grp) AS tn, count(*) FILTER (WHERE truth <> grp AND pred = grp) AS fp, count(*) FILTER (WHERE truth = grp AND pred <> grp) AS fn FROM p, l GROUP BY grp),
  e AS (SELECT *, CAST(tp AS DOUBLE) / CASE WHEN tp + fn = 0 THEN 1e-5 ELSE tp + fn END AS tpr_, CAST(tn AS DOUBLE) / CASE WHEN tn + fp = 0 THEN 1e-5 ELSE tn + fp END AS tnr_, CAST(tp AS DOUBLE) / CASE WHEN tp + fp = 0 THEN 1e-5 ELSE tp + fp END AS ppv_, sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS r FROM c),
  t AS (SELECT grp, tp, tn, fp, fn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS acc, round(tpr_, 6) AS tpr, round(tnr_, 6) AS tnr, round(ppv_, 6) AS ppv, round(CAST(tn AS DOUBLE) / CASE WHEN tn + fn = 0 THEN 1e-5 ELSE tn + fn END, 6) AS npv,
   round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / CASE WHEN r = 0 THEN 1e-5 ELSE r END, 6) AS mcc, round((tpr_ + tnr_) / 2, 6) AS bacc, round(2 * tpr_ * ppv_ / CASE WHEN tpr_ + ppv_ = 0 THEN 1e-5 ELSE tpr_ + ppv_ END, 6) AS f FROM e)"""


def _scores(s, d):
    return am.scores(view(s, d, "preds").select(F.col("truth").cast("string").alias("truth"), F.col("pred").cast("string").alias("pred")))


@query("EVA01_scores", with_("preds", f"{_SCORES} SELECT * FROM t"))
def _(s, d):
    return _scores(s, d)


_STATS = ("acc", "tpr", "tnr", "ppv", "npv", "mcc", "bacc", "f")
_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS stat, " + ", ".join(f"round({f.format(c)}, 6) AS {c}" for c in _STATS) + " FROM t" for k, f in (("MEDIAN", "quantile_cont({}, 0.5)"), ("MEAN", "avg({})"), ("MIN", "min({})"), ("Q1", "quantile_cont({}, 0.25)")))


@query("EVA02_summary", with_("preds", f"{_SCORES} {_ROWS}"))
def _(s, d):
    return am.summary(_scores(s, d))


def _cv(s, d):
    return am.cross_validate(view(s, d, "geno"), _groups(s, d))


_CV = """WITH sized AS (SELECT sample_id, pop AS grp, count(*) OVER (PARTITION BY pop) AS m FROM samples), copies AS (SELECT sample_id, grp, unnest(range(0, CASE WHEN m < 6 THEN CAST(ceil(6.0 / m) AS BIGINT) + 1 ELSE 1 END)) AS copy FROM sized),
  fold_ AS (SELECT repeat, sample_id, grp, copy, row_number() OVER (PARTITION BY repeat, grp ORDER BY md5('1:' || repeat || ':' || sample_id || ':' || copy), sample_id, copy) % 3 AS fold FROM copies, range(0, 2) r(repeat)),
  train AS (SELECT repeat, o AS fold, sample_id, grp FROM fold_, range(0, 3) t(o) WHERE o <> fold),
  prof AS (SELECT repeat, fold, grp, pos, sum(2 - nalt) + 0.1::DOUBLE AS r, sum(nalt) + 0.1::DOUBLE AS a FROM geno JOIN train USING (sample_id) WHERE nalt >= 0 GROUP BY repeat, fold, grp, pos),
  lk AS (SELECT t.repeat, t.fold, t.sample_id, p.grp, round(sum((2 - nalt) * ln(r / (r + a)) + nalt * ln(a / (r + a))), 6) AS loglk FROM (SELECT DISTINCT repeat, fold, sample_id FROM fold_) t JOIN geno USING (sample_id) JOIN prof p ON p.repeat = t.repeat AND p.fold = t.fold AND p.pos = geno.pos WHERE nalt >= 0 GROUP BY ALL),
  best AS (SELECT repeat, fold, sample_id, grp AS pred FROM (SELECT *, row_number() OVER (PARTITION BY repeat, fold, sample_id ORDER BY loglk DESC, grp) AS k FROM lk) WHERE k = 1),
  cv AS (SELECT CAST(repeat AS INT) AS repeat, CAST(fold AS INT) AS fold, sample_id, CAST(copy AS INT) AS copy, grp, pred FROM fold_ JOIN best USING (repeat, fold, sample_id))"""


@query("EVA03_best_iteration", with_(GS, f"{_CV}, it AS (SELECT repeat AS iteration, grp AS truth, pred FROM cv), {_least_mcc('it', 'iteration')} SELECT iteration FROM least ORDER BY least DESC, iteration LIMIT 1"))
def _(s, d):
    t = am.scores(_cv(s, d).select(F.col("repeat").alias("iteration"), F.col("grp").alias("truth"), "pred"), by=["iteration"])
    return am.best_iteration(t)


@query("EVA04_cross_validation", with_(GS, f"{_CV} SELECT * FROM cv"))
def _(s, d):
    return _cv(s, d)


@query("EVA05_segment_scan", with_("geno samples variants", """WITH seg AS (SELECT sample_id, pos, nalt, chrom AS segment FROM geno JOIN variants USING (pos) WHERE nalt >= 0), c AS (SELECT segment, pop AS grp, pos, sum(2 - nalt) + 0.1::DOUBLE AS r, sum(nalt) + 0.1::DOUBLE AS a FROM seg JOIN samples USING (sample_id) GROUP BY segment, pop, pos),
  lk AS (SELECT seg.segment, sample_id, grp, round(sum((2 - nalt) * ln(r / (r + a)) + nalt * ln(a / (r + a))), 6) AS loglk FROM seg JOIN c ON seg.pos = c.pos AND seg.segment = c.segment GROUP BY seg.segment, sample_id, grp),
  pr AS (SELECT segment, sample_id, grp AS pred FROM (SELECT *, row_number() OVER (PARTITION BY segment, sample_id ORDER BY loglk DESC, grp) AS k FROM lk) WHERE k = 1)
  SELECT segment, g.grp, count(*) FILTER (WHERE pop = g.grp AND pred = g.grp) AS tp, count(*) FILTER (WHERE pop <> g.grp AND pred = g.grp) AS fp FROM pr JOIN samples USING (sample_id), (SELECT DISTINCT pop AS grp FROM samples) g GROUP BY segment, g.grp"""))  # fmt: skip
def _(s, d):
    v = view(s, d, "variants")
    segments = v.groupBy("chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).withColumn("segment", F.col("chrom"))
    g = view(s, d, "geno").join(v.select("pos", "chrom"), "pos")
    return am.scan_segments(g, _groups(s, d), segments).select("segment", "grp", "tp", "fp")


@query("EVA07_predictions", with_(GS, f"{_CV} SELECT sample_id, string_agg(repeat || ':' || fold || ':' || copy || ':' || pred, ',' ORDER BY repeat, fold, copy, pred) AS predictions FROM cv GROUP BY sample_id"))
def _(s, d):
    each = F.array_sort(F.collect_list(F.struct("repeat", "fold", "copy", "pred")))
    return _cv(s, d).groupBy("sample_id").agg(F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["repeat"], x["fold"], x["copy"], x["pred"])), ",").alias("predictions"))
