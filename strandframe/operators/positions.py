"""Position frames: set algebra, runs, windows, interval and metadata joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import in_ranges, numbered

KEY = ["chrom", "pos"]


def pairs_within(df: DataFrame, group: str, id: str, *, size: int = 1024) -> DataFrame:
    """(group, i, j) for all i < j of a group, with repeats if ids repeat. Members lie in blocks that meet pairwise, and tasks get pairs of blocks, so that no group fills a task."""
    n = df.filter(F.col(group).isNotNull()).groupBy(group).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-n // size))
    own = df.filter(F.col(group).isNotNull() & F.col(id).isNotNull()).withColumn("b", F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int"))
    laid = own.groupBy(group, "b").agg(F.collect_list(id).alias("ids")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = [group, F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")]
    met = laid.groupBy(*key).agg(F.collect_list("ids").alias("sides"))
    # Of two blocks, one side each; a block with itself has one side.
    tasks = max(1, min(400, blocks * blocks))
    x, y = met.filter("lo = hi OR size(sides) = 2").repartition(tasks, group, "lo", "hi"), F.element_at("sides", -1)
    each = x.select(group, (F.col("lo") == F.col("hi")).alias("alone"), y.alias("others"), F.explode(F.col("sides")[0]).alias("p"))
    both = each.select(group, "alone", "p", F.explode("others").alias("q")).filter("p <> q AND (NOT alone OR p < q)")
    return both.select(group, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; of equal positions the first frame's stays."""
    both = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))
    rest = [c for c in a.columns if c not in KEY]
    first = both.groupBy(*KEY).agg(F.min(F.struct("src", *rest)).alias("r"))
    return first.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in rest], F.col("r.src").alias("src"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose position is in b; repeats stay."""
    return a.join(b.select(*KEY), KEY, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), KEY, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, *, compat: bool = False) -> DataFrame:
    """Rows of either whose position is not in the other; compat leaves out those of b."""
    left = difference(a, b)
    return left if compat else left.unionByName(difference(b, a))


def fold(frames: list[DataFrame], how: str) -> DataFrame:
    """Folds frames from the left by union, intersection, difference or symmetric_difference."""
    step = {"union": lambda a, b: union(a, b).drop("src"), "intersection": intersection, "difference": difference, "symmetric_difference": symmetric_difference}[how]
    return reduce(step, frames)


def lengths(df: DataFrame) -> DataFrame:
    """Adds length of a range frame (start, end) and pos where it is one position."""
    return df.withColumn("length", F.col("end") - F.col("start")).withColumn("pos", F.when(F.col("end") - F.col("start") == 1, F.col("end")))


def to_bed(df: DataFrame, *, minimal: bool = True) -> DataFrame:
    """chrom, start, end (half open) first; a position frame becomes ranges of one."""
    ranged = df if "start" in df.columns else df.withColumns({"start": F.col("pos") - 1, "end": F.col("pos")})
    rest = [] if minimal else [c for c in ranged.columns if c not in ("chrom", "start", "end", "length", "pos")]
    return ranged.select("chrom", "start", "end", *rest)


def to_pos(df: DataFrame) -> DataFrame:
    """chrom and pos of a range frame; raises where a range is longer than one."""
    one = F.when(F.col("end") - F.col("start") == 1, F.col("end")).otherwise(F.raise_error(F.concat(F.lit("range longer than one at "), F.col("end").cast("string"))).cast("long"))
    return df.select("chrom", one.alias("pos"))


def runs(df: DataFrame, value: Column, order: str) -> DataFrame:
    """Adds run: the number of changes of value so far (null is a value) in the order of a numeric column of distinct values.

    Windows run inside ranges of the order; one row per range carries the last value and the number of changes on to the next.
    """
    inside, ahead = Window.partitionBy("__part").orderBy(order), Window.partitionBy().orderBy("__part")
    ranged = in_ranges(df.withColumn("__v", F.struct(value.alias("x"))), order)
    ends = ranged.groupBy("__part").agg(F.max_by("__v", order).alias("__end"))
    ends = ends.select("__part", F.lag("__end").over(ahead).alias("__prev"))
    last = F.coalesce(F.lag("__v").over(inside), F.col("__prev"))
    flagged = ranged.join(ends, "__part").withColumn("__new", F.when(last.isNull() | (last == F.col("__v")), 0).otherwise(1))
    flagged = flagged.withColumn("__sum", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = flagged.groupBy("__part").agg(F.sum("__new").alias("__m"))
    sums = sums.select("__part", F.coalesce(F.sum("__m").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = flagged.join(sums, "__part").withColumn("run", F.col("__sum") + F.col("__before"))
    return out.drop("__part", "__v", "__prev", "__new", "__sum", "__before")


def mhap_codes(df: DataFrame) -> DataFrame:
    """(run, mhapidx, code): runs of equal mhapidx in order of pos as chrom:first:offset,offset; a change of chrom alone does not split."""
    each = runs(df, F.col("mhapidx"), "pos")
    parts = F.array_sort(F.collect_list(F.struct("pos", "chrom")))
    g = each.groupBy("run", "mhapidx").agg(parts.alias("p"))
    first = F.get("p", 0)
    offsets = F.transform(F.slice("p", 2, F.size("p")), lambda x: (x["pos"] - first["pos"]).cast("string"))
    code = F.concat_ws(":", first["chrom"], first["pos"], F.when(F.size("p") > 1, F.array_join(offsets, ",")))
    return g.select("run", "mhapidx", code.alias("code"))


def gene_runs(df: DataFrame, *, gene: str = "gene", order: str = "pos", skip_null: bool = False, longer_than: int = -1) -> DataFrame:
    """(gene, first, last, n) of runs of one gene. A null gene closes a run, or is passed over with skip_null; last - first must exceed longer_than, in row numbers."""
    indexed = numbered(df, order, "idx")
    base = indexed.filter(F.col(gene).isNotNull()) if skip_null else indexed
    got = runs(base, F.col(gene), order).filter(F.col(gene).isNotNull()).groupBy("run", gene)
    out = got.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return out.filter(F.col("hi") - F.col("lo") > longer_than).drop("run", "lo", "hi")


def chrom_runs(df: DataFrame) -> DataFrame:
    each = runs(df, F.col("chrom"), "pos")
    return each.groupBy("run", "chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("run")


def sliding_windows(df: DataFrame, *, size: int, min_snp: int = 3) -> DataFrame:
    """(chrom, first, last, n): from each position as far as size reaches; kept where the right edge moves on and min_snp positions are in it.

    Positions are laid into bins as wide as the window, each with the next one beside it, so no task orders a chromosome.
    Right edges never move back, so of the windows with one right edge the first is the one that moved it on.
    """
    own = F.floor(F.col("pos") / max(1, size))
    laid = df.select("chrom", "pos").withColumn("own", own).withColumn("bin", F.explode(F.array("own", F.col("own") - 1)))
    ahead = Window.partitionBy("chrom", "bin").orderBy("pos").rangeBetween(0, size)
    w = laid.withColumns({"last": F.max("pos").over(ahead), "n": F.count("*").over(ahead)}).filter((F.col("own") == F.col("bin")) & (F.col("n") >= min_snp))
    return w.groupBy("chrom", "last").agg(F.min("pos").alias("first"), F.min_by("n", "pos").alias("n")).select("chrom", "first", "last", "n")


def in_intervals(points: DataFrame, intervals: DataFrame, *, bin_size: int = 64) -> DataFrame:
    """Points (chrom, pos) with the intervals (chrom, start_pos, end_pos) that hold them. Intervals are laid into bins of fixed width, so the join is by equality."""
    bins = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_pos") / bin_size), F.floor(F.col("end_pos") / bin_size))))
    return points.withColumn("bin", F.floor(F.col("pos") / bin_size)).join(bins, ["chrom", "bin"]).filter(F.col("pos").between(F.col("start_pos"), F.col("end_pos"))).drop("bin")


def select_positions(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows at the wanted positions in the order asked for (ord)."""
    return df.join(wanted, KEY).orderBy("ord")


def lookup(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """Wanted positions with the index (idx) of the last row that has them; null where none does."""
    return wanted.join(df.groupBy(*KEY).agg(F.max("idx").alias("idx")), KEY, "left")


def join_metadata(samples: DataFrame, meta: DataFrame, on: str, columns: dict[str, str] | None = None, *, tag: str = "", how: str = "inner") -> DataFrame:
    """Samples with columns of meta, renamed as given and tagged; all of them by default."""
    columns = columns or {c: c for c in meta.columns if c != on}
    return samples.join(meta.select(on, *[F.col(k).alias(tag + v) for k, v in columns.items()]), on, how)


def unmatched(samples: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    return samples.join(meta.select(on), on, "left_anti").select(on)


def zip_rows(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Row i of a beside row i of b, in the order of distinct columns."""
    return numbered(a, order_a, "row").join(numbered(b, order_b, "row"), "row")
