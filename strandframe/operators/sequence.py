"""Sequences as rows (ord, label, seq): projections, filters and aggregates on built-in functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import COMPLEMENT_COMPAT, COMPLEMENT_STANDARD, IUPAC, codons

BASES = ("A", "C", "G", "T", "N", "-")


def complement(seq: Column, table: str = "compat") -> Column:
    """Complement, case kept. The compat table maps V to G and swaps S with W; symbols that no table has stay as they are."""
    return F.translate(seq, *{"compat": COMPLEMENT_COMPAT, "standard": COMPLEMENT_STANDARD}[table])


def reverse_complement(seq: Column, table: str = "compat") -> Column:
    return F.reverse(complement(seq, table))


def degap(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))


def translate(seq: Column, *, start: int = 1, cds: bool = True, table: str = "compat", include_last: bool = False) -> Column:
    """Protein of a reading frame; unknown codons give X. The last complete codon is left out unless include_last; cds stops at *."""
    # Symbols become digits and codons numbers of a base, which index an array; other symbols share the last digit.
    symbols = "TCAGRYKMSWBDHVN-"
    digits, base = "0123456789abcdefg", len(symbols) + 1
    known = codons(table)
    amino = "".join(known.get("".join(c), "X") for c in product(symbols + "?", repeat=3))
    frame = F.regexp_replace(F.upper(F.substring(seq, F.lit(start), F.length(seq))), f"[^{symbols}]", "?")
    found = F.regexp_extract_all(F.translate(frame, symbols + "?", digits), F.lit("(.{3})"), 1)
    whole = F.size(found) if include_last else F.size(found) - F.when(F.length(frame) % 3 == 0, 1).otherwise(0)
    codes = F.split(F.lit(amino), "")
    protein = F.array_join(F.transform(F.slice(found, 1, F.greatest(whole, F.lit(0))), lambda c: F.get(codes, F.conv(c, base, 10).cast("int"))), "")
    return F.substring_index(protein, "*", 1) if cds else protein


def restriction_sites(seq: Column, pattern: str, *, max_unmatches: int = 0, inclusive: bool = False) -> Column:
    """array<struct<pos, mismatches>> of the 0-based offsets at which the pattern fits; ambiguity symbols of the pattern match their bases. The last offset counts only if inclusive."""
    last = F.length(seq) - len(pattern) - (0 if inclusive else 1)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def wrong(letters: Column, i: Column) -> Column:
        total = F.lit(0)
        for j, p in enumerate(pattern):
            total = total + F.when(F.get(letters, i + j).isin(p, *IUPAC.get(p, "")), 0).otherwise(1)
        return total

    # The letters are split once: reading them by place from the string would start at the front each time.
    each = F.transform(F.array(F.split(seq, "")), lambda s: F.filter(F.transform(at, lambda i: F.struct(i.alias("pos"), wrong(s, i).alias("mismatches"))), lambda x: x["mismatches"] <= max_unmatches))
    return F.get(each, 0)


def gaps(seq: Column) -> Column:
    """array<struct<start, extent>> of the runs of gaps."""

    def of(letters: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(letters) - 1)
        gap = lambda i: F.coalesce(F.get(letters, i) == "-", F.lit(False))
        starts, ends = F.filter(at, lambda i: gap(i) & ~gap(i - 1)), F.filter(at, lambda i: gap(i) & ~gap(i + 1))
        return F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("start"), (y - x + 1).alias("extent")))

    return F.get(F.transform(F.array(F.split(seq, "")), of), 0)


def relative_position(seq: Column, pos: int | Column) -> Column:
    """0-based alignment column to position without gaps; a gap maps to the base before it, -1 in a leading gap."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.length(degap(F.substring(seq, F.lit(1), pos + 1))) - 1


def absolute_position(seq: Column, pos: int) -> Column:
    """0-based position without gaps to alignment column; null beyond the end."""
    return F.length(F.regexp_extract(seq, rf"^((?:-*[^-]){{{pos + 1}}})", 1)).cast("int") - F.when(F.length(degap(seq)) > pos, 1)


def composition(seq: Column, symbols: tuple[str, ...] = BASES) -> dict[str, Column]:
    """Counts of symbols; L is their sum."""
    counts = {b: F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in symbols}
    return counts


def length_filter(df: DataFrame, *, seq: str = "seq", minlen: int = 0, maxlen: int = 0, max_n: float = 0) -> DataFrame:
    """Keeps sequences of minlen to maxlen symbols whose share of upper-case N is not above max_n; an option of 0 or less is off."""
    if minlen > 0:
        df = df.filter(F.length(seq) >= minlen)
    if maxlen > 0:
        df = df.filter(F.length(seq) <= maxlen)
    if max_n > 0:
        n = F.length(seq) - F.length(F.replace(F.col(seq), F.lit("N"), F.lit("")))
        df = df.filter(~(F.try_divide(n, F.length(seq)) > max_n) | (F.length(seq) == 0))
    return df


def deflate(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Drops empty and all-gap sequences."""
    return df.filter(F.length(degap(F.col(seq))) > 0)


def columns_of(df: DataFrame, seq: str = "seq", key: str = "ord") -> DataFrame:
    """Long form of an alignment: (key, col, base), columns from 0."""
    return df.filter(F.length(seq) > 0).select(key, F.posexplode(F.split(seq, "")).alias("col", "base")).filter("base <> ''")


def rebuilt(long: DataFrame, key: str = "ord") -> DataFrame:
    """Sequences again from (key, col, base), in column order."""
    parts = F.array_sort(F.collect_list(F.struct("col", "base")))
    return long.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["base"]), "").alias("seq"))


def shrink_gaps(df: DataFrame, *, compat: bool = False) -> DataFrame:
    """Drops the columns that are gaps in every sequence; compat never drops column 0. Per-column flags are few rows and joined back."""
    long = columns_of(df)
    solid = long.groupBy("col").agg(F.max(F.col("base") != "-").alias("solid")).filter(F.col("solid") | F.lit(compat) & (F.col("col") == 0)).select("col")
    return rebuilt(long.join(solid, "col"))


def condense(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps the columns in which a sequence differs from the first one, case aside; N and n of others are not looked at. Also returns the 1-based positions kept."""
    long = columns_of(df)
    first = df.orderBy("ord").limit(1)
    head = columns_of(first).select("col", F.col("base").alias("ref"))
    off = (F.upper("base") != F.upper("ref")) & ~F.col("base").isin("N", "n")
    kept = long.join(head, "col").groupBy("col").agg(F.max(off).alias("off")).filter("off").select("col")
    return rebuilt(long.join(kept, "col")), kept.select((F.col("col") + 1).alias("position"))


def dereplicate(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per distinct sequence; labels joined by # in order, ord of the first."""
    each = F.array_sort(F.collect_list(F.struct("ord", "label")))
    return df.groupBy(seq).agg(F.min("ord").alias("ord"), F.array_join(F.transform(each, lambda x: x["label"]), "#").alias("label"), F.count("*").alias("n"))


def deduplicate(df: DataFrame) -> DataFrame:
    """First sequence of each label, by ord: an aggregate, so a label that many rows share needs no sort."""
    first = df.groupBy("label").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != "label"]), "ord").alias("r"))
    return first.select("label", "r.*").select(df.columns)


def haplotype_clusters(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Sequences by SHA-256: digest, size, first ord."""
    return df.groupBy(F.sha2(seq, 256).alias("digest")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def sequence_type(df: DataFrame) -> DataFrame:
    """DNA, RNA or PROTEIN by the first, the last and the middle sequence by ord (of n the one after n // 2 others).

    The shares of acgt and of acgu among the symbols that are no gaps (- and ~) are averaged over the three. If one of the
    means is above a half, the larger one decides, and RNA is meant where they are equal. No sequences count as DNA.
    """
    n = df.agg(F.count("*").alias("__n"))
    places = F.array(F.lit(1).cast("long"), F.col("__n"), F.floor(F.col("__n") / 2) + 1)
    picked = numbered(df.select("ord", "seq"), "ord").join(n.select(F.explode(places).alias("number")), "number")
    of = lambda letters: F.coalesce(F.try_divide(F.length(F.regexp_replace("seq", f"[^{letters}{letters.upper()}]", "")), F.length(F.regexp_replace("seq", "[-~]", ""))), F.lit(0.0))
    dna, rna = F.avg(of("acgt")), F.avg(of("acgu"))
    return picked.agg(F.when(F.coalesce(F.greatest(dna, rna), F.lit(0.0)) <= 0.5, F.when(F.count("*") == 0, "DNA").otherwise("PROTEIN")).when(dna > rna, "DNA").otherwise("RNA").alias("seqtype"))


def lengths(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Longest sequence, and whether all are as long."""
    return df.agg(F.max(F.length(seq)).alias("max_seqlen"), (F.min(F.length(seq)) == F.max(F.length(seq))).alias("is_unilen"))


def relabel(df: DataFrame, *, prefix: str = "") -> DataFrame:
    """Numbers rows by ord, at least four digits wide, and keeps the old label.

    Row numbers come from a sort by range: each range's count shifts the next one, so no task holds all rows.
    """
    dealt = numbered(df, "ord")
    return dealt.withColumn("new_label", F.format_string(prefix + "%04d", "number"))


#: Ranges of an order at most; their bounds are on the driver.
MOST_RANGES = 1000


def in_ranges(df: DataFrame, by: str, rows: int = 4096) -> DataFrame:
    """Adds __part: the range of a numeric column that a row falls in. Ranges are cut at approximate quantiles, so they hold alike many rows, about `rows` of them or a MOST_RANGES-th of all."""
    parts = max(1, min(df.count() // rows, MOST_RANGES))
    if parts == 1:
        return df.withColumn("__part", F.lit(0).cast("long"))
    from pyspark.ml.feature import Bucketizer

    d = df.withColumn("__d", F.col(by).cast("double"))
    cuts = sorted(set(d.approxQuantile("__d", [i / parts for i in range(1, parts)], 0.25 / parts)))
    out = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__d", outputCol="__part", handleInvalid="keep").transform(d)
    return out.withColumn("__part", F.col("__part").cast("long")).drop("__d")


def numbered(df: DataFrame, by: str, name: str = "number") -> DataFrame:
    """Adds row numbers from 1 in the order of a numeric column of distinct values, over ranges of it."""
    ranged = in_ranges(df, by)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__m"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__m").over(Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return ranged.join(before, "__part").withColumn(name, (inside + F.col("__before")).cast("long")).drop("__part", "__m", "__before")


def encode_haplotype(h: Column) -> Column:
    """Base-5 number of a haplotype over -ACGT; 27 symbols at most."""
    return F.conv(F.translate(h, "-ACGT", "01234"), 5, 10).cast("long")


def decode_haplotype(n: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(n.cast("string"), 10, 5), length, "0"), "01234", "-ACGT")


def parse_definition(line: Column) -> dict[str, Column]:
    """Of a definition line 'label [k=v; flag] text': label, attribute map (flags without a value are dropped) and the text after."""
    inner = F.regexp_extract(line, r"\[([^\]]*)\]", 1)
    pairs = F.filter(F.transform(F.split(inner, r";\s*"), lambda x: F.split(F.trim(x), "=", 2)), lambda p: F.size(p) == 2)
    attrs = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))
    return {"label": F.regexp_extract(line, r"^(\S+)", 1), "attr": attrs, "definition": F.trim(F.regexp_replace(line, r"^\S+\s*(?:\[[^\]]*\])?", ""))}


def build_attributes(attrs: Column) -> Column:
    """'[k=v; k2=v2]' of a map, by key; empty for an empty map."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return F.when(F.size(attrs) > 0, F.concat(F.lit("["), text, F.lit("]"))).otherwise("")


def accession(label: Column) -> Column:
    """ACC of gi|n|gb|ACC| labels of the known databases; other labels stay."""
    parts = F.split(label, r"\|")
    return F.when((F.size(parts) >= 4) & parts[0].eqNullSafe("gi") & F.get(parts, 2).isin("gb", "dbj", "ref", "emb"), F.get(parts, 3)).otherwise(label)


def year_of(text: Column) -> Column:
    """First four digits in a row, or '-'."""
    y = F.regexp_extract(text, r"(\d{4})", 1)
    return F.when(y == "", "-").otherwise(y)


def run_code(codes: Column) -> Column:
    """Runs of alignment moves (letters I, D, M) as '3M1D'."""
    return F.array_join(F.transform(F.regexp_extract_all(codes, F.lit(r"(I+|D+|M+)"), 1), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def mhap_columns(code: Column) -> Column:
    """'CHR:first:off,off' as column names 'CHR:pos'; a code of one position has no offsets."""
    p = F.split(code, ":")
    offsets = F.filter(F.split(F.coalesce(F.get(p, 2), F.lit("")), ","), lambda o: o != "")
    rest = F.transform(offsets, lambda o: F.concat(p[0], F.lit(":"), (p[1].cast("long") + o.cast("long")).cast("string")))
    return F.concat(F.array(F.concat(p[0], F.lit(":"), p[1])), rest)


def fasta_records(df: DataFrame, width: int = 120) -> DataFrame:
    """One text column: definition line and wrapped residues."""
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return df.select("ord", F.concat(F.lit(">"), F.col("label"), F.lit("\n"), wrapped).alias("value"))


def phylip_blocks(df: DataFrame, width: int = 60) -> DataFrame:
    """Interleaved blocks (chunk, ord, value): names stand in the first block only."""
    n = F.greatest(F.lit(0), F.ceil(F.length("seq") / width) - 1).cast("int")
    cut = df.select("ord", "label", "seq", F.explode(F.sequence(F.lit(0), n)).alias("chunk"))
    part = F.expr(f"substring(seq, chunk * {width} + 1, {width})")
    return cut.select("chunk", "ord", F.concat(F.when(F.col("chunk") == 0, F.rpad("label", F.greatest(F.lit(11), F.length("label") + 1), " ")).otherwise(""), part).alias("value"))


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """Alignments joined by label in the order given; a label must be in all."""
    out = parts[0].select("label", F.col("seq").alias("s0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select("label", F.col("seq").alias(f"s{i}")), "label")
    return out.select("label", F.concat(*[F.col(f"s{i}") for i in range(len(parts))]).alias("seq"))


def edited(seq: Column, *, at: int, insert: str = "", delete: int = 0) -> Column:
    """Replaces delete symbols from a 0-based place by insert."""
    return F.overlay(seq, F.lit(insert), at + 1, delete)
