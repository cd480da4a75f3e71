"""Genotype matrices beside their positions, group colours, position lists, and the sinks of regions and of assignment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import numbered
from .variants import write_table


def _lines(spark: SparkSession, path: str, limit: int | None) -> tuple[DataFrame, list[str]]:
    """(row, line) of a table's lines after its header, from 1 in the order of the file, at most limit of them; and the header."""
    raw = spark.read.text(path).withColumn("__o", F.monotonically_increasing_id())
    head = raw.filter("__o = 0").first()
    rows = numbered(raw.filter("__o > 0"), "__o", "row").select("row", F.col("value").alias("line"))
    return rows.filter(F.col("row") <= limit) if limit else rows, (head["value"].rstrip("\r").split("\t") if head else [])


def read_position_rows(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """(row, columns of the header..) of a tab-separated position file, the first rows of it if limited."""
    rows, names = _lines(spark, path, limit)
    cells = F.split("line", "\t")
    return rows.select("row", *[F.get(cells, i).alias(n) for i, n in enumerate(names)])


def paired_lines(spark: SparkSession, genotypes: str, positions: str, *, limit: int | None = None) -> DataFrame:
    """(row, pos_line, geno_line): both files line by line, as text."""
    g, p = _lines(spark, genotypes, limit)[0], _lines(spark, positions, limit)[0]
    return p.withColumnRenamed("line", "pos_line").join(g.withColumnRenamed("line", "geno_line"), "row")


def read_paired(spark: SparkSession, genotypes: str, positions: str, *, codes: dict[str, int], limit: int | None = None) -> DataFrame:
    """(row, columns of the position file.., sample, nalt) of a genotype matrix of codes with a header of samples. A line with another number of cells, or a cell without a code, raises."""
    samples, names = _lines(spark, genotypes, 1)[1], _lines(spark, positions, 1)[1]
    cells = F.split("geno_line", "\t")
    checked = F.when(F.size(cells) == len(samples), cells).otherwise(F.raise_error(F.concat(F.lit("another number of samples in row "), F.col("row").cast("string"))))
    table = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    each = F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample"), F.transform(checked, lambda c: F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("no code for "), c)).cast("int"))).alias("nalt"))
    rows = paired_lines(spark, genotypes, positions, limit=limit)
    place = F.split("pos_line", "\t")
    return rows.select("row", *[F.get(place, i).alias(n) for i, n in enumerate(names)], F.inline(each))


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    """(grp, colour) of a tab-separated file with a header."""
    df = spark.read.csv(path, header=True, sep="\t")
    return df.select(F.col(f"`{df.columns[0]}`").alias("grp"), F.col(f"`{df.columns[1]}`").alias("colour"))


def coloured(groups: DataFrame, colours: DataFrame) -> DataFrame:
    """groups with the colour of grp; a group without one raises."""
    out = groups.join(colours, "grp", "left")
    return out.withColumn("colour", F.coalesce("colour", F.raise_error(F.concat(F.lit("no colour for group "), F.col("grp")))))


def read_snp_index(spark: SparkSession, path: str) -> DataFrame:
    """(snp_idx) of a text of whole numbers, parted by white space; what follows # is a comment."""
    words = F.filter(F.split(F.regexp_replace("value", "#.*", ""), r"\s+"), lambda x: x != "")
    return spark.read.text(path).select(F.explode(F.transform(words, lambda x: x.cast("long"))).alias("snp_idx"))


def save_region(cells: DataFrame, prefix: str | None, folder: str, *, kind: str = "nalt", form: str = "parquet", positions: DataFrame | None = None) -> str:
    """Writes a region's cells (snp_idx, sample, value), and its positions if given; returns the path of the matrix.

    Without a prefix the name tells the kind, the number of samples and that of SNPs, as in n-100-2000. form is parquet (long)
    or tab (lines of SNPs with a header of samples, in the order of snp_idx, gzipped).
    """
    if prefix is None:
        n = cells.agg(F.countDistinct("sample").alias("s"), F.countDistinct("snp_idx").alias("p")).first()
        prefix = f"{kind[0]}-{n['s']}-{n['p']}"
    path = f"{folder}/{prefix}.{kind}"
    if form == "parquet":
        path += ".parquet"
        cells.repartitionByRange("snp_idx").sortWithinPartitions("snp_idx", "sample").write.mode("overwrite").parquet(path)
    else:
        path += ".txt.gz"
        lines = cells.groupBy("snp_idx").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("r"))
        lines = lines.select("snp_idx", F.array_join(F.transform("r", lambda x: x["value"].cast("string")), "\t").alias("value"))
        names = cells.select("sample").distinct().agg(F.array_join(F.array_sort(F.collect_list("sample")), "\t").alias("value")).select(F.lit(-1).cast("long").alias("snp_idx"), "value")
        names.unionByName(lines).orderBy("snp_idx").select("value").write.mode("overwrite").option("compression", "gzip").text(path)
    if positions is not None:
        write_table(positions, f"{folder}/{prefix}.pos.parquet")
    return path


def save_results(prefix: str, *, scores: DataFrame | None = None, snps: DataFrame | None = None, predictions: DataFrame | None = None) -> dict[str, str]:
    """Writes what an assignment run gives: scores as tab-separated text, chosen SNPs and predictions as Parquet; returns the paths."""
    out = {}
    for name, df, end in (("scores", scores, "tsv"), ("snps", snps, "parquet"), ("predictions", predictions, "parquet")):
        if df is not None:
            out[name] = f"{prefix}.{name}.{end}"
            write_table(df, out[name])
    return out
