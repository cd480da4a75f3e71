"""Allele calls from read depths, genotype recoding and variant filters. Calls are rows (sample_id, pos, ad array<int>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED, HET = "X", "N"


def call(ad: Column, *, mindepth: int = 5, hetratio: float = 0.67, minaltdepth: int = 2, het_rule: str = "or") -> dict[str, Column]:
    """Masks and index of the most covered allele (the first of equals).

    total is the positive depth plus 1e-3. failed: total below mindepth. het: the share of the highest below hetratio, or (and,
    for het_rule 'and') at least minaltdepth other reads; a hetratio of -1 switches both off (major allele mode).
    """
    highest = F.array_max(ad)
    total = F.aggregate(F.filter(ad, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x) + F.lit(1e-3)
    ratio, other = highest / total < hetratio, total - highest >= minaltdepth
    if minaltdepth < 0:
        other = F.lit(False)
    het = {"or": ratio | other, "and": ratio & other}[het_rule]
    return {"idx": (F.array_position(ad, highest) - 1).cast("int"), "failed": total < mindepth, "het": het if hetratio >= 0 else F.lit(False)}


def genotype_call(gt: Column) -> dict[str, Column]:
    """The same from a diploid genotype: a negative sum fails, 1 is het, 2 is the alternate allele."""
    total = F.aggregate(gt, F.lit(0), lambda a, x: a + x)
    return {"idx": F.when(total >= 2, 1).otherwise(F.greatest(total, F.lit(0))), "failed": total < 0, "het": total == 1}


def barcode(c: dict[str, Column], alleles: Column) -> Column:
    """Allele letters; N for het, X for failed, which overrides."""
    return F.when(c["failed"], FAILED).when(c["het"], HET).otherwise(F.element_at(alleles, c["idx"] + 1))


def realmccoil(c: dict[str, Column]) -> Column:
    return F.when(c["failed"], -1.0).when(c["het"], 0.5).otherwise(F.least(c["idx"], F.lit(1)).cast("double"))


def hmmibd(c: dict[str, Column], *, het_masked: bool = False) -> Column:
    """Allele index, -1 where failed; hets cannot be shown."""
    if het_masked:
        raise ValueError("this output cannot hold het calls; call the major allele")
    return F.when(c["failed"], -1).otherwise(c["idx"])


def depth_index(ad: Column, *, mindepth: int = 5) -> Column:
    """Index of the most covered allele; 255 below the depth."""
    depth = F.aggregate(ad, F.lit(0), lambda a, x: a + x)
    return F.when(depth < mindepth, 255).otherwise(F.array_position(ad, F.array_max(ad)) - 1).cast("int")


def ralt(ref: Column, alt: Column, *, mindepth: int = 5) -> dict[str, Column]:
    """Share of the first column of reads (-1 below the depth), reads of the rarer one, depth."""
    depth = ref + alt
    return {"ratio": F.when(depth < mindepth, -1.0).otherwise(F.try_divide(ref, depth)), "minor": F.least(ref, alt), "depth": depth}


def nalt(ratio: Column, minor: Column, *, threshold: float = -1, minmdp: int = -1) -> Column:
    """Alternate dosage of a ratio: majority (threshold below 0: above 0.5 is 2), a het band, or the band with more than minmdp minor reads."""
    if threshold < 0:
        return F.when(ratio < 0, -1).when(ratio > 0.5, 2).otherwise(0)
    band = (ratio > threshold) & (ratio < 1 - threshold)
    if minmdp >= 0:
        band = band & (minor > minmdp)
    return F.when(ratio < 0, -1).when(band, 1).when(ratio < 0.5, 0).otherwise(2)


#: Genotype codes as allele pairs or single codes; the na tables read missing codes as het where they can.
DIPLOID = {"0": [0, 0], "2": [1, 1], "-1": [-1, -1], "1": [0, 1]}
HAPLOID = {"0": [0], "2": [2], "-1": [-1], "1": [1]}
DIPLOID_NA = {"0": [0, 0], "2": [1, 1], "-1": [0, 1], "1": [0, 1]}
HAPLOID_NA = {"0": [0], "2": [2], "-1": [1], "1": [1]}


def recode(code: Column, table: dict[str, list[int]]) -> Column:
    """Genotype text to allele codes; unknown text gives null."""
    out = F.lit(None).cast("array<int>")
    for k, v in table.items():
        out = F.when(code == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def ordered(df: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Values of each group as one string, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias(name))


def dense_codes(df: DataFrame, value: str, name: str = "code") -> DataFrame:
    """Distinct non-null values numbered from 1 in sorted order; missing ones are 255. The alphabet is small and numbered in one place."""
    from pyspark.sql import Window

    codes = df.select(value).filter(F.col(value).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.partitionBy().orderBy(value)).cast("int"))
    return df.join(codes, value, "left").withColumn(name, F.coalesce(name, F.lit(255)))


def factorise(df: DataFrame, value: str, order: str, name: str = "hap_id") -> DataFrame:
    """Distinct values numbered from 0 in the order in which they are first seen."""
    from .sequence import numbered

    first = df.groupBy(value).agg(F.min(order).alias("first"))
    ids = numbered(first, "first", name).withColumn(name, F.col(name) - 1)
    return df.join(ids.select(value, name), value)


def microhaplotypes(alleles: DataFrame, codes: DataFrame) -> DataFrame:
    """(sample_id, code, mhap): alleles (sample_id, chrom, pos, allele) of the positions of each code (code, chrom, pos) in order; any X makes it X, else any N makes it N, and so does a missing cell X."""
    want = codes.groupBy("code").agg(F.count("*").alias("want"))
    got = alleles.join(codes, ["chrom", "pos"])
    joined = ordered(got, ["sample_id", "code"], "pos", F.col("allele"), "mhap").join(got.groupBy("sample_id", "code").agg(F.count("*").alias("have")), ["sample_id", "code"]).join(want, "code")
    m = F.col("mhap")
    return joined.select("sample_id", "code", F.when((F.col("have") < F.col("want")) | m.contains(FAILED), FAILED).when(m.contains(HET), HET).otherwise(m).alias("mhap"))


def microhaplotype_counts(mhaps: DataFrame) -> DataFrame:
    """Missing and het counts per code; a het one counts after missing ones are masked."""
    return mhaps.groupBy("code").agg(F.count_if(F.col("mhap") == FAILED).alias("missing"), F.count_if(F.col("mhap") == HET).alias("het"))


def numerics(mhaps: DataFrame) -> DataFrame:
    """Adds code_no: haplotypes of a code by descending frequency, then text, from 1; X is 0."""
    from pyspark.sql import Window

    freq = mhaps.filter(F.col("mhap") != FAILED).groupBy("code", "mhap").agg(F.count("*").alias("n"))
    ranked = freq.withColumn("code_no", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "mhap")).cast("int"))
    return mhaps.join(ranked.select("code", "mhap", "code_no"), ["code", "mhap"], "left").withColumn("code_no", F.coalesce("code_no", F.lit(0)))


def wide(df: DataFrame, ids: list[str], *, key: str = "sample_id", column: str = "pos_id", value: str = "allele") -> DataFrame:
    """One row per sample and one column per named position, for sinks."""
    return df.groupBy(key).pivot(column, ids).agg(F.first(value))


# ---- filters ---------------------------------------------------------------------------------------------------------


def no_indels(df: DataFrame, ref: str = "ref", alts: str = "alts") -> DataFrame:
    return df.filter((F.length(ref) == 1) & F.forall(alts, lambda a: F.length(a) == 1))


def filter_chroms(df: DataFrame, chroms: list[str]) -> DataFrame:
    """Equality, so chr1 does not let chr10 pass."""
    return df.filter(F.col("chrom").isin(*chroms))


def exclude_keywords(df: DataFrame, keywords: list[str], column: str = "filter") -> DataFrame:
    """Drops variants whose FILTER holds one of the keywords, split at ; or ,."""
    return df.filter(~F.coalesce(F.arrays_overlap(F.split(column, "[;,]"), F.array(*map(F.lit, keywords))), F.lit(False)))


def kept_variants(geno: DataFrame, n_samples: int | Column, *, missing: float | None = None, het: float | None = None, mac: int | None = None, maf: float | None = None, strict_het: bool = False) -> DataFrame:
    """(pos): variants that pass. Cells that are absent are missing.

    missing and het drop at a share of at least the threshold; a missing call counts as het unless strict_het. mac and maf
    drop below theirs; the allele counts are over called genotypes.
    """
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    code = F.col("nalt")
    stats = geno.groupBy("pos").agg(F.count_if(code == 0).alias("r"), F.count_if(code == 1).alias("h"), F.count_if(code == 2).alias("a"))
    stats = stats.withColumns({"miss": n - F.col("r") - F.col("h") - F.col("a"), "n0": 2 * F.col("r") + F.col("h"), "n1": 2 * F.col("a") + F.col("h")})
    test = F.lit(True)
    if missing is not None:
        test &= ~(F.col("miss") / n >= missing)
    if het is not None:
        test &= ~((F.col("h") + (F.lit(0) if strict_het else F.col("miss"))) / n >= het)
    if mac is not None:
        test &= ~(F.least("n0", "n1") < mac)
    if maf is not None:
        test &= ~F.coalesce(1 - F.try_divide(F.greatest("n0", "n1"), F.col("n0") + F.col("n1")) < maf, F.lit(True))
    return stats.filter(test).select("pos")


def redetermine(ad: Column, gt: Column, *, mindepth: int = 5, minread: int = 2) -> Column:
    """Genotype again from depths: './.' below the depth, else the one or two alleles with at least minread reads; otherwise as it was."""
    seen = F.filter(F.transform(ad, lambda x, i: F.when(x >= minread, i)), lambda i: i.isNotNull())
    depth = F.aggregate(ad, F.lit(0), lambda a, x: a + x)
    pair = lambda x, y: F.concat(x.cast("string"), F.lit("/"), y.cast("string"))
    return F.when(depth < mindepth, "./.").when(F.size(seen) == 1, pair(F.get(seen, 0), F.get(seen, 0))).when(F.size(seen) >= 2, pair(F.get(seen, 0), F.get(seen, 1))).otherwise(gt)


def duplicate_positions(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom", "pos").agg(F.count("*").alias("n")).filter("n > 1")


def complete(depths: DataFrame, n_other: int | Column, *, of: str = "sample_id", mindepth: int = 5) -> DataFrame:
    """(of): samples (or variants) whose depth over the first two alleles reaches mindepth everywhere; n_other is how many places that is."""
    ok = F.count_if(F.col("ad0") + F.col("ad1") >= mindepth)
    return depths.groupBy(of).agg(ok.alias("ok")).filter(F.col("ok") == n_other).select(of)


def subset(df: DataFrame, wanted: DataFrame, on: str, *, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Rows of the wanted keys; check gets the keys that are not there."""
    if check:
        check(wanted.join(df, on, "left_anti"))
    return df.join(wanted, on, "left_semi")


def set_missing(value: Column, alleles: list[str]) -> Column:
    return F.when(~value.isin(*alleles), value)


def haplotype_sequences(calls: DataFrame) -> DataFrame:
    """(sample_id, seq) from (sample_id, pos, nalt, ref, alt1): the homozygous base, N for the rest, in order of position."""
    base = F.when(F.col("nalt") == 0, F.col("ref")).when(F.col("nalt") == 2, F.col("alt1")).otherwise("N")
    return ordered(calls, ["sample_id"], "pos", base, "seq")


def split_geno(df: DataFrame, *, key: str = "SAMPLE") -> tuple[DataFrame, DataFrame]:
    """A wide genotype frame as (alleles: sample, chrom, pos, allele) of its CHR:POS columns and the rest; rows whose sample starts with % are metadata."""
    cols = [c for c in df.columns if ":" in c]
    samples = df.filter(~F.col(key).startswith("%"))
    long = samples.unpivot([key], [F.col(f"`{c}`") for c in cols], "place", "allele")
    alleles = long.select(F.col(key).alias("sample"), F.substring_index("place", ":", 1).alias("chrom"), F.substring_index("place", ":", -1).cast("long").alias("pos"), "allele")
    return alleles, df.select(*[c for c in df.columns if ":" not in c])


def colours(df: DataFrame, value: str, wheel: list[str]) -> DataFrame:
    """Adds a colour per distinct value, going round a wheel in the values' order."""
    coded = dense_codes(df, value, "__k")
    return coded.withColumn("colour", F.element_at(F.array(*map(F.lit, wheel)), ((F.col("__k") - 1) % len(wheel) + 1).cast("int"))).drop("__k")
