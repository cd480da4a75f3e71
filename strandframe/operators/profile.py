"""Column profiles of alignments, consensus and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import AA_SYMBOLS, IGNORED, IUPAC, NA_SYMBOLS, union_symbols
from .sequence import columns_of, literal_map

THRESHOLDS = (0.5, 0.7, 0.8, 0.9, 0.99)


def fit(df: DataFrame, *, symbols: str = NA_SYMBOLS, apriori: float = 1e-10, weight: str | None = None) -> DataFrame:
    """(col, symbol, k, weight): symbol weights per column, normalised where they sum to 1 or more. k is the symbol's rank.

    Ignored symbols do not count; ambiguity symbols outside the alphabet share their weight among their bases; others raise.
    """
    key = df.columns[0] if "ord" not in df.columns else "ord"
    long = columns_of(df, key=key)
    if weight:
        long = long.join(df.select(key, F.col(weight).alias("w")), key)
    else:
        long = long.withColumn("w", F.lit(1.0))
    long = long.withColumn("base", F.upper("base")).groupBy("col", "base").agg(F.sum("w").alias("w"))
    own = {s: s for s in symbols} | {k: v for k, v in IUPAC.items() if k not in symbols and symbols != AA_SYMBOLS} | {c: "" for c in IGNORED}
    of = F.try_element_at(literal_map(own), F.col("base"))
    spread = long.withColumn("of", F.coalesce(of, F.raise_error(F.concat(F.lit("unknown symbol "), F.col("base")))))
    counts = spread.filter("of <> ''").select("col", F.explode(F.split("of", "")).alias("symbol"), (F.col("w") / F.length("of")).alias("w"))
    counts = counts.groupBy("col", "symbol").agg(F.sum("w").alias("w"))
    # All symbols of a column in one row each, from a map per column: no join with the alphabet.
    each = counts.groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "w"))).alias("m"))
    full = each.select("col", F.posexplode(F.transform(F.array(*map(F.lit, symbols)), lambda s: F.struct(s.alias("symbol"), (apriori + F.coalesce(F.try_element_at("m", s), F.lit(0.0))).alias("w")))).alias("k", "x"))
    total = F.sum("x.w").over(Window.partitionBy("col"))
    return full.select("col", "x.symbol", "k", F.when(total >= 1, F.col("x.w") / total).otherwise(F.col("x.w")).alias("weight"))


def consensus(profile: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, *, symbol: str | None = None, reference: str | None = None, synthetic: bool = False) -> DataFrame:
    """(threshold, consensus): per column the heaviest symbol (ties: alphabet order), lower case or `symbol` below the threshold.

    synthetic takes the second best for a gap; with a reference equal symbols become dots.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("weight", 9)).alias("minus"), "k", "symbol", "weight")))
    best = profile.groupBy("col").agg(ranked.alias("r")).select("col", F.col("r")[0].alias("a"), F.col("r")[1].alias("b"))
    each = best.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    weak = F.lit(symbol) if symbol else F.lower("a.symbol")
    c = F.when(F.col("a.weight") < F.col("threshold"), weak).otherwise(F.col("a.symbol"))
    if synthetic:
        c = F.when(c == "-", F.col("b.symbol")).otherwise(c)
    if reference:
        c = F.when(F.substring(F.lit(reference), F.col("col") + 1, F.lit(1)) == c, ".").otherwise(c)
    parts = F.array_sort(F.collect_list(F.struct("col", c.alias("c"))))
    return each.groupBy("threshold").agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("consensus"))


def likelihood(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(ord, loglk) of aligned sequences; symbols without a weight are skipped."""
    long = columns_of(df).withColumn("base", F.upper("base"))
    joined = long.join(profile.select("col", F.col("symbol").alias("base"), "weight"), ["col", "base"])
    return joined.groupBy("ord").agg(F.round(F.sum(F.ln("weight")), 6).alias("loglk"))


def merge(df: DataFrame, group: str = "grp") -> DataFrame:
    """(group, seq): per group and column the symbol for the union of the bases; a gap where there are none."""
    long = df.filter(F.length("seq") > 0).select(group, F.posexplode(F.split("seq", "")).alias("col", "base")).filter("base <> ''")
    sets = long.groupBy(group, "col").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") != "-", F.col("base")))), "").alias("k"))
    symbol = F.when(F.col("k") == "", "-").otherwise(F.coalesce(F.try_element_at(literal_map(union_symbols()), F.col("k")), F.lit("N")))
    parts = F.array_sort(F.collect_list(F.struct("col", symbol.alias("s"))))
    return sets.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("seq"))
