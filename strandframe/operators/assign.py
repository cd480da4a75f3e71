"""Population assignment: SNP profiles, likelihoods, feature selection, evaluation and cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .popgen import fst_of

PRIOR = 0.1
TINY = 1e-5


def fit(geno: DataFrame, groups: DataFrame, *, prior: float = PRIOR, pooled: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by.., grp, pos, log_ref, log_alt): log allele shares per group and position, from called genotypes on a prior.

    groups is (sample_id, grp); pooled adds the group H_0 of all samples. by names extra key columns that groups carries.
    """
    by = by or []
    g = geno.filter("nalt >= 0").join(groups, "sample_id")
    if pooled:
        g = g.unionByName(g.withColumn("grp", F.lit("H_0")))
    c = g.groupBy(*by, "grp", "pos").agg((F.sum(2 - F.col("nalt")) + F.lit(prior)).alias("r"), (F.sum("nalt") + F.lit(prior)).alias("a"))
    return c.select(*by, "grp", "pos", F.ln(F.col("r") / (F.col("r") + F.col("a"))).alias("log_ref"), F.ln(F.col("a") / (F.col("r") + F.col("a"))).alias("log_alt"))


def likelihood(geno: DataFrame, profile: DataFrame, *, by: list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(by.., sample_id, grp, loglk): sum over called positions; wanted restricts to (by.., sample_id)."""
    by = by or []
    g = geno.filter("nalt >= 0")
    if wanted is not None:
        g = g.join(wanted, "sample_id")
    lk = (2 - F.col("nalt")) * F.col("log_ref") + F.col("nalt") * F.col("log_alt")
    return g.join(profile, [*by, "pos"]).groupBy(*by, "sample_id", "grp").agg(F.round(F.sum(lk), 6).alias("loglk"))


def predict(lk: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """(by.., sample_id, pred): the likeliest group, the first of equals."""
    best = F.min_by("grp", F.struct(-F.col("loglk"), F.col("grp")))
    return lk.groupBy(*(by or []), "sample_id").agg(best.alias("pred"))


def top_groups(lk: DataFrame, k: int = 3) -> DataFrame:
    """(sample_id, rank, grp, prob): the k likeliest groups, their likelihoods normalised among these."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("loglk")).alias("minus"), "grp"))), 1, k)
    r = lk.groupBy("sample_id").agg(ranked.alias("r"))
    odds = F.transform("r", lambda x: F.exp(-x["minus"] + F.get("r", 0)["minus"]))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    each = F.transform("r", lambda x, i: F.struct((i + 1).alias("rank"), x["grp"].alias("grp"), (F.exp(-x["minus"] + F.get("r", 0)["minus"]) / total).alias("prob")))
    return r.select("sample_id", F.explode(each).alias("x")).select("sample_id", "x.rank", "x.grp", "x.prob")


def select_snps(geno: DataFrame, *, keep: list[int] | None = None, random: int | None = None, seed: int = 1) -> DataFrame:
    """All positions, a fixed list, or a number of them by a seeded hash."""
    if keep is not None:
        return geno.filter(F.col("pos").isin(keep))
    if random is not None:
        some = geno.select("pos").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), "pos")), "pos").limit(random)
        return geno.join(some, "pos", "left_semi")
    return geno


def tree_nodes(tree: list) -> list[tuple[str, list[str], list[str]]]:
    """(node, left groups, right groups) of a binary guide tree of nested pairs, the root first."""
    leaves = lambda t: [t] if isinstance(t, str) else [x for part in t for x in leaves(part)]
    out: list[tuple[str, list[str], list[str]]] = []

    def walk(t, name: str) -> None:
        if isinstance(t, str):
            return
        if len(t) != 2:
            raise ValueError("a guide tree is binary")
        out.append((name, leaves(t[0]), leaves(t[1])))
        walk(t[0], name + "0")
        walk(t[1], name + "1")

    walk(tree, "n")
    return out


def hierarchical_fst(counts: DataFrame, tree: list, *, k: int = 3) -> DataFrame:
    """(node, rank, pos, fst): the k positions of highest FST at each node of the guide tree, all nodes in one pass over (grp, pos, n0, n1)."""
    sides = [(n, g, i) for n, left, right in tree_nodes(tree) for i, part in enumerate((left, right)) for g in part]
    each = F.array(*[F.struct(F.lit(n).alias("node"), F.lit(g).alias("g"), F.lit(i).alias("side")) for n, g, i in sides])
    laid = counts.withColumn("x", F.explode(F.filter(each, lambda x: x["g"] == F.col("grp"))))
    side = lambda i, c: F.sum(F.when(F.col("x.side") == i, F.col(c)).otherwise(0))
    p = laid.groupBy(F.col("x.node").alias("node"), "pos").agg(*[side(i, c).alias(f"{c}_{i}") for i in (0, 1) for c in ("n0", "n1")])
    f = p.withColumn("fst", F.round(fst_of(*[F.col(f"{c}_{i}") for i in (0, 1) for c in ("n0", "n1")]), 6))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("fst"), "pos"))
    return f.withColumn("rank", rank).filter(F.col("rank") <= k).select("node", "rank", "pos", "fst")


def dosages(geno: DataFrame, positions: list[int], missing: float) -> DataFrame:
    """(sample_id, x): the codes of each sample as one array in the order of positions, `missing` where there is none. One row per sample, whatever the number of positions; no column for each."""
    at = geno.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(positions)], "pos long, i int")
    cells = geno.join(at, "pos").groupBy("sample_id", "i").agg(F.first("nalt").cast("double").alias("v")).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(max(0, len(positions) - 1)))
    return cells.select("sample_id", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float(missing)))).alias("x"))


def tree_features(geno: DataFrame, groups: DataFrame, *, positions: list[int], depth: int = 5, forest: bool = False, least: float = 0.15, seed: int = 1) -> DataFrame:
    """(pos, importance): positions that a decision tree (or, above `least`, a random forest) uses to tell groups apart; missing calls count as -1."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    v = dosages(geno, positions, -1).join(groups, "sample_id").select("grp", array_to_vector("x").alias("features"))
    indexed = StringIndexer(inputCol="grp", outputCol="label", stringOrderType="alphabetAsc").fit(v).transform(v)
    kind = RandomForestClassifier(maxDepth=depth, seed=seed, numTrees=30) if forest else DecisionTreeClassifier(maxDepth=depth, seed=seed)
    weights = kind.fit(indexed).featureImportances.toArray()
    rows = [(p, float(w)) for p, w in zip(positions, weights, strict=True) if w > (least if forest else 0)]
    return geno.sparkSession.createDataFrame(rows, "pos long, importance double")


def classify(geno: DataFrame, groups: DataFrame, *, positions: list[int], model: str = "logistic", seed: int = 1) -> DataFrame:
    """(sample_id, pred) by a generic classifier over dosages: logistic, or naive Bayes (multinomial, complement, gaussian, bernoulli)."""
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = dosages(geno.filter("nalt >= 0"), positions, 0).join(groups, "sample_id")
    x = F.transform("x", lambda c: F.when(c > 0, 1.0).otherwise(0.0)) if model == "bernoulli" else F.col("x")
    v = rows.select("sample_id", "grp", array_to_vector(x).alias("features"))
    labels = StringIndexer(inputCol="grp", outputCol="label", stringOrderType="alphabetAsc").fit(v)
    kind = LogisticRegression(maxIter=50) if model == "logistic" else NaiveBayes(modelType=model)
    out = kind.fit(labels.transform(v)).transform(labels.transform(v))
    return IndexToString(inputCol="prediction", outputCol="pred", labels=labels.labels).transform(out).select("sample_id", "pred")


def refine(geno: DataFrame, groups: DataFrame, counts: DataFrame, tree: list, *, target: float = 0.75, max_iter: int = 10) -> DataFrame:
    """(pos, reached) chosen by FST, taking one more per node until the least MCC of a group reaches the target, max_iter times at most; reached tells whether it did."""
    chosen, reached = None, False
    for k in range(1, max_iter + 1):
        chosen = hierarchical_fst(counts, tree, k=k).select("pos").distinct()
        g = geno.join(chosen, "pos", "left_semi")
        pred = predict(likelihood(g, fit(g, groups))).join(groups, "sample_id")
        least = scores(pred.select(F.col("grp").alias("truth"), "pred")).agg(F.min("mcc")).first()[0]
        reached = least is not None and least >= target
        if reached:
            break
    return chosen.withColumn("reached", F.lit(reached))


def scores(pairs: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """(by.., grp, tp, tn, fp, fn, acc, tpr, tnr, ppv, npv, mcc, bacc, f) of (truth, pred), for every label of either; denominators of 0 are 1e-5."""
    by = by or []
    labels = F.array_distinct(F.array("truth", "pred"))
    cells = pairs.groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))
    laid = cells.select(*by, "truth", "pred", "n", F.explode(labels).alias("grp"))
    t, p = F.col("truth") == F.col("grp"), F.col("pred") == F.col("grp")
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = laid.groupBy(*by, "grp").agg(part(t & p).alias("tp"), part(~t & p).alias("fp"), part(t & ~p).alias("fn"))
    keyed = cells.withColumn("one", F.lit(1))
    n = keyed.groupBy(*by, "one").agg(F.sum("n").alias("all"))
    g = g.withColumn("one", F.lit(1)).join(n, [*by, "one"]).withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: a / F.when(b == 0, TINY).otherwise(b)
    tpr, tnr, ppv = over(tp, tp + fn), over(tn, tn + fp), over(tp, tp + fp)
    out = {
        "acc": over(tp + tn, tp + tn + fp + fn), "tpr": tpr, "tnr": tnr, "ppv": ppv, "npv": over(tn, tn + fn),
        "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "bacc": (tpr + tnr) / 2, "f": over(2 * tpr * ppv, tpr + ppv),
    }
    return g.select(*by, "grp", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(k) for k, c in out.items()])


def summary(table: DataFrame, columns: tuple[str, ...] = ("acc", "tpr", "tnr", "ppv", "npv", "mcc", "bacc", "f")) -> DataFrame:
    """(stat, columns..): MEDIAN, MEAN, MIN and Q1 rows of a score table, percentiles exact."""
    kinds = {"MEDIAN": lambda c: F.percentile(c, 0.5), "MEAN": F.avg, "MIN": F.min, "Q1": lambda c: F.percentile(c, 0.25)}
    wide = table.agg(*[F.struct(*[F.round(f(c), 6).alias(c) for c in columns]).alias(k) for k, f in kinds.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), *[F.col(f"{k}.{c}").alias(c) for c in columns]) for k in kinds])).alias("x")).select("x.*")


def best_iteration(table: DataFrame, *, by: str = "iteration", score: str = "mcc") -> DataFrame:
    """(iteration) whose least score is the highest; the first of equals."""
    least = table.groupBy(by).agg(F.min(score).alias("least"))
    return least.agg(F.min_by(by, F.struct(-F.col("least"), F.col(by))).alias(by))


def folds(groups: DataFrame, *, k: int, repeats: int, seed: int = 1) -> DataFrame:
    """(repeat, fold, sample_id, grp, copy): stratified folds by a seeded hash; groups of fewer than 2k members are replicated."""
    size = groups.groupBy("grp").agg(F.count("*").alias("m"))
    more = groups.join(size, "grp").withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("m") < 2 * k, F.ceil(2 * k / F.col("m"))).otherwise(0).cast("int"))))
    each = more.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    w = Window.partitionBy("repeat", "grp").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "repeat", "sample_id", "copy")), "sample_id", "copy")
    return each.withColumn("fold", (F.row_number().over(w) % k).cast("int")).select("repeat", "fold", "sample_id", "grp", "copy")


def cross_validate(geno: DataFrame, groups: DataFrame, *, k: int = 3, repeats: int = 2, seed: int = 1) -> DataFrame:
    """(repeat, fold, sample_id, copy, grp, pred): every fold is predicted from the others, all folds in one plan keyed by (repeat, fold)."""
    dealt = folds(groups, k=k, repeats=repeats, seed=seed)
    train = dealt.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("out <> fold").select("repeat", F.col("out").alias("fold"), "sample_id", "grp")
    profile = fit(geno, train, by=["repeat", "fold"])
    test = dealt.select("repeat", "fold", "sample_id").distinct()
    pred = predict(likelihood_by_fold(geno, profile, test), by=["repeat", "fold"])
    return dealt.join(pred, ["repeat", "fold", "sample_id"]).select("repeat", "fold", "sample_id", "copy", "grp", "pred")


def likelihood_by_fold(geno: DataFrame, profile: DataFrame, test: DataFrame) -> DataFrame:
    g = geno.filter("nalt >= 0").join(test, "sample_id")
    lk = (2 - F.col("nalt")) * F.col("log_ref") + F.col("nalt") * F.col("log_alt")
    return g.join(profile, ["repeat", "fold", "pos"]).groupBy("repeat", "fold", "sample_id", "grp").agg(F.round(F.sum(lk), 6).alias("loglk"))


def scan_segments(geno: DataFrame, groups: DataFrame, segments: DataFrame) -> DataFrame:
    """Scores of each segment (segment, first, last) on its own, over all segments at once: fit and predict keyed by segment."""
    at = geno.join(segments, F.col("pos").between(F.col("first"), F.col("last"))) if "chrom" not in geno.columns else geno.join(segments, "chrom").filter(F.col("pos").between(F.col("first"), F.col("last")))
    profile = fit(at.select("sample_id", "pos", "nalt", "segment"), groups, by=["segment"])
    lk = likelihood(at.select("sample_id", "pos", "nalt", "segment"), profile, by=["segment"])
    pred = predict(lk, by=["segment"]).join(groups, "sample_id")
    return scores(pred.select("segment", F.col("grp").alias("truth"), "pred"), by=["segment"])


def haplotype_profile(haps: DataFrame, groups: DataFrame, *, prior: float = PRIOR) -> DataFrame:
    """(region, grp, hap, logp): smoothed log shares of the haplotypes (sample_id, region, hap) of each region, over those seen anywhere in it."""
    g = haps.join(groups, "sample_id")
    kinds = g.groupBy("region").agg(F.collect_set("hap").alias("haps"))
    own = g.groupBy("region", "grp").agg(F.count("*").alias("n"))
    seen = g.groupBy("region", "grp", "hap").agg(F.count("*").alias("k"))
    full = own.join(kinds, "region").select("region", "grp", "n", F.size("haps").alias("m"), F.explode("haps").alias("hap"))
    j = full.join(seen, ["region", "grp", "hap"], "left")
    return j.select("region", "grp", "hap", F.ln((F.coalesce("k", F.lit(0)) + prior) / (F.col("n") + prior * F.col("m"))).alias("logp"))


def haplotype_likelihood(haps: DataFrame, profile: DataFrame) -> DataFrame:
    return haps.join(profile, ["region", "hap"]).groupBy("sample_id", "grp").agg(F.round(F.sum("logp"), 6).alias("loglk"))


