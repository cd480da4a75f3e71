"""Commands: python -m strandframe.cli COMMAND ..., each a composition of readers, operators and writers."""

from __future__ import annotations

import argparse
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import align, calls, positions, profile, qc
from .operators import sequence as sq
from .sources import sequences as io
from .sources import traces, trees, variants

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(arguments: Callable[[argparse.ArgumentParser], None]) -> Callable:
    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = (f, arguments)
        return f

    return add


def _files(p: argparse.ArgumentParser, *more: tuple) -> None:
    p.add_argument("infile", nargs="+")
    p.add_argument("-o", "--outfile", required=True)
    for name, kw in more:
        p.add_argument(name, **kw)


_opt = lambda *more: lambda p: _files(p, *more)


def _read(spark: SparkSession, a) -> DataFrame:
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [io.read(spark, f) for f in a.infile])


def _table(df: DataFrame, a) -> None:
    variants.write_table(df, a.outfile)


@command(_opt(("--minlen", {"type": int, "default": 0}), ("--maxlen", {"type": int, "default": 0}), ("--maxN", {"type": float, "default": 0}), ("--degap", {"action": "store_true"}), ("--upper", {"action": "store_true"}), ("--accession", {"action": "store_true"}), ("--sort", {"choices": ["len", "lab"]}), ("--summary", {"action": "store_true"})))
def readseq(spark, a):
    """Reads, filters, sorts and converts sequences."""
    df = _read(spark, a)
    if a.accession:
        df = df.withColumn("label", sq.accession(F.col("label")))
    if a.degap:
        df = df.withColumn("seq", sq.degap(F.col("seq")))
    if a.upper:
        df = df.withColumn("seq", F.upper("seq"))
    df = sq.length_filter(df, minlen=a.minlen, maxlen=a.maxlen, max_n=a.maxN)
    if a.summary:
        return _table(df.agg(*[F.sum(c).alias(b) for b, c in sq.composition(F.col("seq"), ("A", "C", "G", "T", "-")).items()]), a)
    if a.sort:
        order = [F.length("seq").desc(), "ord"] if a.sort == "len" else ["label", "ord"]
        df = df.orderBy(*order).withColumn("ord", F.monotonically_increasing_id())
    return io.write_fasta(df, a.outfile)


@command(_opt())
def statseq(spark, a):
    """Base composition of each sequence."""
    n = sq.composition(F.col("seq"))
    return _table(_read(spark, a).select("label", *[c.alias(b) for b, c in n.items()], sum(n.values(), F.lit(0)).alias("L")), a)


@command(_opt())
def stathap(spark, a):
    """Haplotype clusters by digest."""
    return _table(sq.haplotype_clusters(_read(spark, a)), a)


@command(_opt())
def dereplicate(spark, a):
    """One sequence per distinct residues."""
    return io.write_fasta(sq.dereplicate(_read(spark, a)), a.outfile)


@command(_opt())
def deduplicate(spark, a):
    """First sequence of each label."""
    return io.write_fasta(sq.deduplicate(_read(spark, a).select("ord", "label", "seq")), a.outfile)


@command(_opt())
def condense(spark, a):
    """Variable columns of an alignment."""
    df = _read(spark, a)
    kept, _ = sq.condense(df)
    return io.write_fasta(kept.join(df.select("ord", "label"), "ord"), a.outfile)


@command(_opt(("--synthetic", {"action": "store_true"})))
def consensus(spark, a):
    """Consensus at the usual thresholds."""
    out = profile.consensus(profile.fit(_read(spark, a)), synthetic=a.synthetic)
    return io.write_fasta(out.select((F.col("threshold") * 100).cast("long").alias("ord"), F.concat(F.lit("cons-"), F.col("threshold").cast("string")).alias("label"), F.col("consensus").alias("seq")), a.outfile)


@command(_opt(("--start_position", {"type": int, "default": 1}), ("--start_sequence", {}), ("--all", {"action": "store_true"})))
def translate(spark, a):
    """Translates from a position, or from the one hit of a start sequence."""
    df = _read(spark, a)
    if a.start_sequence:
        df = df.withColumn("seq", F.upper(sq.degap(F.col("seq")))).withColumn("hits", sq.restriction_sites(F.col("seq"), a.start_sequence.upper()))
        one = F.when(F.size("hits") == 1, F.col("hits")[0]["pos"]).otherwise(F.raise_error(F.concat(F.lit("not one start in "), F.col("label"))).cast("int"))
        df = df.withColumn("seq", F.substring(F.col("seq"), one + 1, F.length("seq")))
    return io.write_fasta(df.withColumn("seq", sq.translate(F.col("seq"), start=1 if a.start_sequence else a.start_position, cds=not a.all)), a.outfile)


@command(_opt(("--prefix", {"default": ""}), ("--mapfile", {})))
def relabel(spark, a):
    """Numbers sequences and writes the old names beside."""
    out = sq.relabel(_read(spark, a), prefix=a.prefix)
    if a.mapfile:
        variants.write_table(out.select("new_label", "label"), a.mapfile)
    return io.write_fasta(out.withColumn("label", F.col("new_label")), a.outfile)


@command(_opt())
def concatseq(spark, a):
    """Joins alignments by label."""
    out = sq.concatenate([io.read(spark, f) for f in a.infile])
    return io.write_fasta(out.withColumn("ord", F.monotonically_increasing_id()), a.outfile)


@command(_opt())
def gb2table(spark, a):
    """GenBank records as a table."""
    df = _read(spark, a)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("file").orderBy("label"))
    return _table(df.select("file", n.alias("idx"), "label", F.upper("seq").alias("seq"), *[F.col("attr")[k].alias(k) for k in io.PROMOTED]), a)


@command(_opt(("--table", {"required": True})))
def prepbeast(spark, a):
    """Labels with a year, from a table of label and date text."""
    dates = variants.read_table(spark, a.table)
    label, text = dates.columns[:2]
    df = _read(spark, a).join(dates.select(F.col(label).alias("label"), F.col(text).alias("date")), "label")
    return io.write_fasta(df.withColumn("label", F.concat_ws("/", "label", sq.year_of(F.col("date")))), a.outfile)


@command(_opt(("-k", {"type": int, "default": 5})))
def patdist(spark, a):
    """The nearest taxa of each taxon of a Newick tree."""
    from .operators.popgen import patristic

    text = "".join(r[0] for r in spark.read.text(a.infile).collect())
    p = patristic(trees.ancestors(spark, trees.parse_newick(text)))
    both = p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, a.k)
    return _table(both.groupBy("i").agg(near.alias("x")).select("i", F.explode("x").alias("x")).select("i", "x.j", "x.d"), a)


@command(_opt(("--how", {"choices": ["union", "intersection", "difference", "symmetric_difference"], "default": "union"}), ("--bed", {"action": "store_true"})))
def postopos(spark, a):
    """Folds position files and writes positions or BED."""
    out = positions.fold([variants.read_positions(spark, f).select("chrom", "pos") for f in a.infile], a.how)
    return _table(positions.to_bed(out) if a.bed else out, a)


@command(_opt(("--winsize", {"type": int, "default": 10}), ("--threshold", {"type": int, "default": 20})))
def trimread(spark, a):
    """Trims traces by quality."""
    t = traces.read_traces(spark, a.infile)
    kw = {"winsize": a.winsize, "threshold": a.threshold}
    b = traces.trim_bounds(F.col("quals"), **kw)
    attrs = F.create_map(F.lit("start"), b["start"].cast("string"), F.lit("stop"), b["stop"].cast("string"))
    return io.write_fasta(t.select(F.monotonically_increasing_id().alias("ord"), F.regexp_extract("file", r"([^/]+)$", 1).alias("label"), traces.trimmed(F.col("bases"), F.col("quals"), **kw).alias("seq"), attrs.alias("attr")), a.outfile)


@command(_opt(("--reference", {"required": True})))
def mapread(spark, a):
    """Maps trimmed traces to a reference, on the better strand."""
    ref = io.read(spark, a.reference).orderBy("ord").first()["seq"].upper()
    t = traces.read_traces(spark, a.infile).select("file", traces.trimmed(F.col("bases"), F.col("quals")).alias("seq"))

    @F.pandas_udf("strand string, score double, start int, stop int, moves string")
    def run(seqs: pd.Series) -> pd.DataFrame:
        got = [align.map_both_strands(s, ref) for s in seqs]
        return pd.DataFrame([(k, r["score"], r["start_i"], r["end_i"], r["moves"]) for k, r in got], columns=["strand", "score", "start", "stop", "moves"])

    m = t.withColumn("m", run("seq"))
    return _table(m.select("file", "m.strand", "m.score", "m.start", "m.stop", sq.run_code(F.col("m.moves")).alias("code")), a)


@command(_opt(("--reference", {"required": True}), ("--minlen", {"type": int, "default": 0})))
def recircularize(spark, a):
    """Turns circular sequences to the reference's start."""
    ref = io.read(spark, a.reference).orderBy("ord").first()["seq"]
    out = align.recircularise_all(_read(spark, a), ref, minlen=a.minlen)
    return io.write_fasta(out.withColumn("ord", F.monotonically_increasing_id()), a.outfile)


@command(_opt(("--reference", {"required": True}), ("--least", {"type": int, "default": 15})))
def recircularize2(spark, a):
    """Lays circular sequences in the frame of the whole reference; what stands over its ends is merged in."""
    ref = io.read(spark, a.reference).select(F.upper("seq").alias("__r")).limit(1)
    out = align.recircularise_columns(_read(spark, a).select("label", sq.degap(F.col("seq")).alias("seq")).join(ref), "seq", "__r", least=a.least)
    return io.write_fasta(out.select("label", F.col("circle").alias("seq")).withColumn("ord", F.monotonically_increasing_id()), a.outfile)


@command(lambda p: None)
def showcmds(spark, a):
    """Lists the commands."""
    print("\n".join(f"{name}\t{f.__doc__}" for name, (f, _) in sorted(COMMANDS.items())))


@command(_opt(("--by", {"choices": ["sample", "pos"], "default": "sample"})))
def vcf2qc(spark, a):
    """Genotype classes per sample or variant."""
    _, c = variants.read_vcf(spark, a.infile)
    g = c.select("sample", "chrom", "pos", F.when(F.exists("gt", lambda x: x < 0), -1).otherwise(F.aggregate("gt", F.lit(0), lambda x, y: x + F.least(y, F.lit(1)))).alias("nalt"))
    other = g.select("pos" if a.by == "sample" else "sample").distinct().count()
    return _table(qc.genotype_classes(g, a.by, other), a)


@command(_opt())
def vcf2table(spark, a):
    """VCF calls as Parquet by chromosome."""
    _, c = variants.read_vcf(spark, a.infile)
    return variants.save_dataset(c, a.outfile)


@command(_opt(("--mindepth", {"type": int, "default": 5}), ("--hetratio", {"type": float, "default": 0.67}), ("--minaltdepth", {"type": int, "default": 2}), ("--posfile", {}), ("--major", {"action": "store_true"})))
def table2barcode(spark, a):
    """Barcodes from a VCF's or dataset's read depths."""
    v, c = variants.read_vcf(spark, a.infile)
    if a.posfile:
        c = positions.intersection(c, variants.read_positions(spark, a.posfile))
    alleles = v.select("chrom", "pos", F.concat(F.array("ref"), "alts").alias("alleles"))
    made = calls.call(F.col("ad"), mindepth=a.mindepth, hetratio=-1 if a.major else a.hetratio, minaltdepth=-1 if a.major else a.minaltdepth)
    rows = c.join(alleles, ["chrom", "pos"]).withColumn("allele", F.coalesce(calls.barcode(made, F.col("alleles")), F.lit("X"))).withColumn("place", F.struct("chrom", "pos"))
    out = calls.ordered(rows, ["sample"], "place", F.col("allele"), "barcode")
    return _table(out.select(F.col("barcode").alias("#BAR"), F.col("sample").alias("SAMPLE")), a)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandframe")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        arguments(sub.add_parser(name, help=f.__doc__))
    a = parser.parse_args(args)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("strandframe").getOrCreate(), a)


if __name__ == "__main__":
    main()
