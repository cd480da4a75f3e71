"""Sequence files: FASTA, FASTQ, GenBank, EMBL, flat tables, PHYLIP and NEXUS, plain or gzipped.

Readers return rows (file, ord, label, seq, ...). Text formats whose records a separator tells apart are split by Spark; what
needs a state from line to line is parsed record by record in Arrow batches (GenBank and EMBL), or file by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sequence import build_attributes, fasta_records, parse_definition, phylip_blocks

RECORD = "file string, ord long, label string, seq string, definition string, attr map<string,string>"
FEATURES = "array<struct<tag:string,location:string,fields:map<string,array<string>>>>"
#: Rows that leave Python at once.
PORTION = 2000
#: Qualifiers of a source feature that become attributes.
PROMOTED = ("isolate", "strain", "country", "collection_date", "organism", "organelle")


def _records(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value")


def read_fasta(spark: SparkSession, paths: str | list[str], *, keep: str = "sequences") -> DataFrame:
    """FASTA records; blank lines and blanks in residues are dropped. keep: sequences, controls (labels that start with @@) or extra (>@ tracks, with the label of the sequence they follow in owner)."""
    raw = _records(spark, paths, "\n>").withColumn("value", F.regexp_replace("value", r"^\s*>", "")).filter(F.length(F.trim("value")) > 0)
    head, body = F.regexp_extract("value", r"^([^\n]*)", 1), F.regexp_replace("value", r"^[^\n]*\n?", "")
    parts = parse_definition(F.trim(F.regexp_replace(head, r"\r", "")))
    rows = raw.select("file", "ord", parts["label"].alias("label"), F.regexp_replace(body, r"\s+", "").alias("seq"), parts["definition"].alias("definition"), parts["attr"].alias("attr"))
    control, extra = F.col("label").startswith("@@"), F.col("label").startswith("@") & ~F.col("label").startswith("@@")
    if keep == "controls":
        return rows.filter(control).withColumn("label", F.expr("substring(label, 3)"))
    if keep == "extra":
        from pyspark.sql import Window

        before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        owner = F.last(F.when(~F.col("label").startswith("@"), F.col("label")), ignorenulls=True).over(before)
        return rows.withColumn("owner", owner).filter(extra).withColumn("label", F.expr("substring(label, 2)"))
    return rows.filter(~F.col("label").startswith("@"))


def write_fasta(df: DataFrame, path: str, *, width: int = 120, attributes: bool = True) -> None:
    """FASTA files in the order of ord, one per partition of that order."""
    named = df
    if attributes and "attr" in df.columns:
        named = df.withColumn("label", F.concat_ws(" ", "label", F.when(F.size("attr") > 0, build_attributes(F.col("attr")))))
    fasta_records(named, width).orderBy("ord").select("value").write.mode("overwrite").text(path)


def fastq_entries(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, residues, qualities or None) of FASTA and FASTQ text; records may run over lines, and a quality line may start with @."""
    lines = iter(text.splitlines())
    pending = None
    while True:
        if pending is None:
            pending = next((x for x in lines if x[:1] in (">", "@")), None)
            if pending is None:
                return
        name, fastq, pending = pending[1:].split(" ", 1)[0], pending[0] == "@", None
        seq: list[str] = []
        plus = False
        for x in lines:
            if x[:1] == "+" and fastq:
                plus = True
                break
            if x[:1] in (">", "@"):
                pending = x
                break
            seq.append(x.strip())
        residues = "".join(seq)
        if not plus:
            yield name, residues, None
            continue
        quality = ""
        while len(quality) < len(residues) and (x := next(lines, None)) is not None:
            quality += x.strip()
        yield name, residues, quality if len(quality) >= len(residues) else None


def per_file(spark: SparkSession, paths: str | list[str], parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of whole text files, each parsed in one task: (file, ord, ...)."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"], strict=True):
                for rows in batched(((file, i, *r) for i, r in enumerate(parse(text))), PORTION):
                    yield pd.DataFrame(rows, columns=["file", "ord", *names])

    return whole.mapInPandas(run, f"file string, ord long, {schema}")


def per_record(spark: SparkSession, paths: str | list[str], separator: str, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of the records of text files, which Spark splits at a separator, so that neither a task nor Python holds a whole file: (file, ord, ...)."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows in batched(((file, i, *r) for file, i, text in zip(b["file"], b["ord"], b["value"], strict=True) for r in parse(text)), PORTION):
                yield pd.DataFrame(rows, columns=["file", "ord", *names])

    return _records(spark, paths, separator).mapInPandas(run, f"file string, ord long, {schema}")


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return per_file(spark, paths, fastq_entries, "label string, seq string, qual string")


def features(block: list[str]) -> list[dict]:
    """Features of a feature table: key lines indent 5, qualifiers 21; values may run on."""
    out: list[dict] = []
    name = None
    for line in block:
        key, rest = line[5:20].strip(), line[21:].rstrip()
        if key and line[:5].strip() == "":
            out.append({"tag": key, "location": rest.strip(), "fields": {}})
            name = None
        elif out and (m := re.match(r"/(\w+)(?:=(.*))?$", rest.strip())):
            name = m[1]
            out[-1]["fields"].setdefault(name, []).append(m[2] or "")
        elif out and name:
            out[-1]["fields"][name][-1] += ("" if name == "translation" else " ") + rest.strip()
        elif out:
            out[-1]["location"] += rest.strip()
    for f in out:
        f["fields"] = {k: [v.strip('"') for v in vs] for k, vs in f["fields"].items()}
    return out


def genbank_entries(text: str) -> Iterator[tuple]:
    """(label, seq, definition, attr, features) of GenBank records, which // ends."""
    for raw in re.split(r"(?m)^//\s*$", text):
        if not raw.strip():
            continue
        parts: dict[str, list[str]] = {}
        tag = None
        for line in raw.splitlines():
            if line[:1].strip():
                tag = line.split(" ", 1)[0]
                parts.setdefault(tag, []).append(line[12:] if tag != "FEATURES" else "")
            elif tag:
                parts[tag].append(line if tag in ("FEATURES", "ORIGIN") else line.strip())
        table = features(parts.get("FEATURES", [])[1:])
        source = next((f["fields"] for f in table if f["tag"] == "source"), {})
        label = (parts.get("ACCESSION") or parts.get("LOCUS") or [""])[0].split()[:1]
        seq = re.sub(r"[\s\d]", "", "".join(parts.get("ORIGIN", [""])[1:]))
        yield (label[0] if label else "", seq, " ".join(parts.get("DEFINITION", [])), {k: source[k][0] for k in PROMOTED if k in source}, table)


def read_genbank(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return per_record(spark, paths, "\n//", genbank_entries, f"label string, seq string, definition string, attr map<string,string>, features {FEATURES}")


def embl_entries(text: str) -> Iterator[tuple]:
    """(label, seq) of EMBL records, from their ID and SQ blocks."""
    for raw in re.split(r"(?m)^//\s*$", text):
        label, seq, inside = "", [], False
        for line in raw.splitlines():
            if line.startswith("ID"):
                label = re.split(r"[\s;]", line[2:].strip())[0]
            elif line.startswith("SQ"):
                inside = True
            elif inside:
                seq.append(re.sub(r"[\s\d]", "", line))
        if label or seq:
            yield label, "".join(seq)


def read_embl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return per_record(spark, paths, "\n//", embl_entries, "label string, seq string")


def read_flat(spark: SparkSession, paths: str | list[str], *, sep: str = "\t") -> DataFrame:
    """label and sequence per line; what follows the first separator belongs to the sequence."""
    lines = _records(spark, paths, "\n").filter(F.length(F.trim("value")) > 0)
    p = F.split("value", f"\\Q{sep}\\E", 2)
    return lines.select("file", "ord", F.trim(p[0]).alias("label"), F.trim(F.get(p, 1)).alias("seq"))


def phylip_entries(text: str) -> Iterator[tuple]:
    """(label, seq) of interleaved or sequential PHYLIP text."""
    lines = [x for x in text.splitlines() if x.strip()]
    n, width = map(int, lines[0].split()[:2])
    names, seqs = [], []
    for i, line in enumerate(lines[1:]):
        if i < n:
            name, _, rest = line.strip().partition(" ")
            names.append(name)
            seqs.append(rest.replace(" ", ""))
        else:
            seqs[i % n] += line.replace(" ", "")
    yield from ((a, s[:width]) for a, s in zip(names, seqs, strict=True))


def nexus_entries(text: str) -> Iterator[tuple]:
    """(label, seq) of the MATRIX of NEXUS text, interleaved or not, with names from a translation block."""
    names = dict(re.findall(r"(\S+)\s+([^\s,;]+)\s*[,;]", (re.search(r"(?is)translate\b(.*?;)", text) or ["", ""])[1]))
    seqs: dict[str, str] = {}
    for line in re.search(r"(?is)matrix\b(.*?);", text)[1].splitlines():
        if len(p := line.split(None, 1)) == 2:
            seqs[p[0]] = seqs.get(p[0], "") + p[1].replace(" ", "")
    yield from ((names.get(k, k), v) for k, v in seqs.items())


def read_phylip(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return per_file(spark, paths, phylip_entries, "label string, seq string")


def read_nexus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return per_file(spark, paths, nexus_entries, "label string, seq string")


def write_phylip(df: DataFrame, path: str, *, width: int = 60) -> None:
    """Interleaved PHYLIP, header first; one file, so for alignments that one task can write."""
    n = df.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("w"))
    head = n.select(F.lit(-1).alias("chunk"), F.lit(-1).cast("long").alias("ord"), F.concat_ws(" ", "n", "w").alias("value"))
    head.unionByName(phylip_blocks(df, width)).coalesce(1).sortWithinPartitions("chunk", "ord").select("value").write.mode("overwrite").text(path)


def nexus_text(rows: list[tuple[str, str]], *, translation: dict[str, str] | None = None) -> str:
    """A NEXUS data block of a small alignment."""
    kind = "DNA" if all(set(s.upper()) <= set("ACGTURYKMSWBDHVN-?") for _, s in rows) else "PROTEIN"
    out = ["#NEXUS", "BEGIN DATA;", f"DIMENSIONS NTAX={len(rows)} NCHAR={max((len(s) for _, s in rows), default=0)};", f"FORMAT DATATYPE={kind} GAP=- MISSING=?;", "MATRIX"]
    out += [f"{a} {s}" for a, s in rows] + [";", "END;"]
    if translation:
        out += ["BEGIN TREES;", "TRANSLATE " + ", ".join(f"{k} {v}" for k, v in translation.items()) + ";", "END;"]
    return "\n".join(out) + "\n"


def write_nexus(df: DataFrame, path: str, *, width: int = 60, translation: dict[str, str] | None = None) -> None:
    """An interleaved NEXUS data block, and a translation block if given; one file, written by one task that holds a block at a time."""
    upper = F.upper(F.col("seq"))
    n = df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("w"), F.coalesce(F.bool_and(F.length(F.regexp_replace(upper, "[ACGTURYKMSWBDHVN?-]", "")) == 0), F.lit(True)).alias("dna"))
    kind = F.when(F.col("dna"), "DNA").otherwise("PROTEIN")
    head = n.select(F.lit(-1).alias("chunk"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX="), "n", F.lit(" NCHAR="), "w", F.lit(";\nFORMAT DATATYPE="), kind, F.lit(" GAP=- MISSING=? INTERLEAVE;\nMATRIX")).alias("value"))
    block = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / width).cast("int")), lambda k: F.substr("seq", k * width + 1, F.lit(width))))
    body = df.select(F.col("ord").cast("long").alias("ord"), "label", block.alias("chunk", "part")).select("chunk", "ord", F.concat_ws(" ", "label", "part").alias("value"))
    more = ["BEGIN TREES;", "TRANSLATE " + ", ".join(f"{k} {v}" for k, v in translation.items()) + ";", "END;"] if translation else []
    tail = n.select(F.lit(2**31 - 1).alias("chunk"), F.lit(0).cast("long").alias("ord"), F.lit("\n".join([";", "END;", *more])).alias("value"))
    head.unionByName(body).unionByName(tail).coalesce(1).sortWithinPartitions("chunk", "ord").select("value").write.mode("overwrite").text(path)


READERS = {
    **dict.fromkeys(("fas", "fasta", "fa", "fst", "fna", "faa"), read_fasta), **dict.fromkeys(("fastq", "fq"), read_fastq), **dict.fromkeys(("gb", "gbk", "genbank"), read_genbank),
    "embl": read_embl, "tsv": read_flat, "tab": read_flat, "csv": lambda s, p: read_flat(s, p, sep=","), **dict.fromkeys(("phy", "phylip"), read_phylip), **dict.fromkeys(("nex", "nexus"), read_nexus),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reads by extension; .gz is taken off first."""
    ext = re.sub(r"\.gz$", "", path.rstrip("/")).rsplit(".", 1)[-1].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}")
    return READERS[ext](spark, path)
