"""Quality counts per sample and variant, and allele statistics of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def genotype_classes(geno: DataFrame, by: str, n_other: int | Column) -> DataFrame:
    """(by, homref, hets, homalt, miss and their shares); absent cells are missing."""
    n = F.lit(n_other) if isinstance(n_other, int) else n_other
    c = geno.groupBy(by).agg(*[F.count_if(F.col("nalt") == k).alias(x) for k, x in ((0, "homref"), (1, "hets"), (2, "homalt"))])
    c = c.withColumn("miss", n - F.col("homref") - F.col("hets") - F.col("homalt"))
    return c.select(by, "homref", "hets", "homalt", "miss", *[F.round(F.col(x) / n, 6).alias(f"f_{x}") for x in ("homref", "hets", "homalt", "miss")])


def depth_missingness(depths: DataFrame, by: str, n_other: int | Column, *, mindepth: int = 5) -> DataFrame:
    """(by, missing, f_missing): cells whose depth over the first two alleles is below mindepth, absent ones among them."""
    n = F.lit(n_other) if isinstance(n_other, int) else n_other
    c = depths.groupBy(by).agg((n - F.count_if(F.col("ad0") + F.col("ad1") >= mindepth)).alias("missing"))
    return c.withColumn("f_missing", F.round(F.col("missing") / n, 6))


def allele_counts(geno: DataFrame, by: str = "pos", *, strict: bool = False) -> DataFrame:
    """(by, allele_0, allele_1, mac): codes below 0.5 count as the first allele, missing (-1) among them unless strict."""
    g = geno.filter("nalt >= 0") if strict else geno
    c = g.groupBy(by).agg(F.count_if(F.col("nalt") < 0.5).alias("allele_0"), F.count_if(F.col("nalt") >= 0.5).alias("allele_1"))
    return c.withColumn("mac", F.least("allele_0", "allele_1"))


def allele_lengths(alleles: Column) -> Column:
    return F.transform(alleles, lambda a: F.length(a))


def tally(counts: Column) -> Column:
    """Number of alleles with reads."""
    return F.size(F.filter(counts, lambda c: c > 0))


def biallelic_ratio(counts: Column) -> Column:
    """Share of the two most frequent alleles."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    top = F.aggregate(F.slice(F.sort_array(counts, False), 1, 2), F.lit(0.0), lambda a, x: a + x)
    return top / (total + F.lit(1e-300))


def indel_ratio(counts: Column, alleles: Column) -> Column:
    """Share of the reads of alleles longer than one base."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    long = F.aggregate(F.zip_with(counts, alleles, lambda c, a: F.when(F.length(a) > 1, c).otherwise(0)), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(long, total), F.lit(0.0))


def variant_stats(df: DataFrame, counts: str = "counts", alleles: str = "alleles", *, threshold: float = 0.9) -> DataFrame:
    c, a = F.col(counts), F.col(alleles)
    return df.withColumns({"lengths": allele_lengths(a), "tally": tally(c), "biallelic": biallelic_ratio(c), "is_biallelic": biallelic_ratio(c) >= threshold, "indel": indel_ratio(c, a)})
