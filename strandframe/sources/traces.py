"""Capillary traces: SCF 2 and 3, ABIF and PHD files, quality trimming and editing."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "bases string, quals array<int>, basecalls array<int>, a array<int>, c array<int>, g array<int>, t array<int>, metadata map<string,string>"
CHANNELS = "ACGT"


def decode(raw: bytes) -> dict:
    """A trace by its magic bytes; gzip and a 128-byte prefix are taken off."""
    if raw[:2] == b"\x1f\x8b":
        return decode(gzip.decompress(raw))
    if raw[:4] == b".scf":
        return decode_scf(raw)
    if raw[:4] == b"ABIF":
        return decode_abif(raw)
    if raw[128:132] in (b"ABIF", b".scf"):
        return decode(raw[128:])
    raise ValueError("not a trace file")


def decode_scf(raw: bytes) -> dict:
    """SCF: big-endian samples, in version 3 as second differences per channel; quality is that of the called base."""
    samples, at, bases, _, _, bases_at, comments, comments_at = struct.unpack(">8I", raw[4:36])
    version = float(raw[36:40].split(b"\0")[0] or b"2")
    size = struct.unpack(">I", raw[40:44])[0]
    kind = ">u2" if size == 2 else "u1"
    flat = np.frombuffer(raw, kind, 4 * samples, at).astype(np.int64)
    if version >= 3:
        mask = (1 << (8 * size)) - 1
        channels = [np.cumsum(np.cumsum(flat[i * samples : (i + 1) * samples])) & mask for i in range(4)]
        calls = np.frombuffer(raw, ">u4", bases, bases_at).astype(int)
        prob = [np.frombuffer(raw, "u1", bases, bases_at + 4 * bases + i * bases) for i in range(4)]
        letters = raw[bases_at + 8 * bases : bases_at + 9 * bases].decode("latin-1")
    else:
        channels = [flat[i::4] for i in range(4)]
        rows = [struct.unpack(">I4Bc3x", raw[bases_at + 12 * i : bases_at + 12 * i + 12]) for i in range(bases)]
        calls = np.array([r[0] for r in rows], int)
        prob = [np.array([r[1 + i] for r in rows], int) for i in range(4)]
        letters = b"".join(r[5] for r in rows).decode("latin-1")
    channels = [c - min(0, int(c.min())) if len(c) else c for c in channels]
    quals = [int(prob[CHANNELS.index(b.upper())][i]) if b.upper() in CHANNELS else 0 for i, b in enumerate(letters)]
    notes = raw[comments_at : comments_at + comments].split(b"\0")[0].decode("latin-1")
    meta = dict(x.split("=", 1) for x in notes.splitlines() if "=" in x)
    return dict(zip(("bases", "quals", "basecalls", "a", "c", "g", "t", "metadata"), (letters, quals, calls.tolist(), *(c.tolist() for c in channels), meta), strict=True))


def encode_scf(bases: str, quals: list[int], basecalls: list[int], channels: list[list[int]], metadata: dict[str, str]) -> bytes:
    """SCF 3.10 with 16-bit samples."""
    n, k = len(channels[0]), len(bases)
    notes = "".join(f"{a}={b}\n" for a, b in metadata.items()).encode("latin-1") + b"\0"
    body = b""
    for c in channels:
        x = np.asarray(c, np.int64)
        body += (np.diff(np.diff(x, prepend=0), prepend=0) & 0xFFFF).astype(">u2").tobytes()
    bases_at = 128 + len(body)
    body += np.asarray(basecalls, ">u4").tobytes()
    for b in CHANNELS:
        body += bytes(q if x.upper() == b else 0 for x, q in zip(bases, quals, strict=True))
    body += bases.encode("latin-1") + bytes(3 * k)
    comments_at = 128 + len(body)
    head = b".scf" + struct.pack(">8I", n, 128, k, 0, 0, bases_at, len(notes), comments_at) + b"3.10" + struct.pack(">4I", 2, 0, 0, 0)
    return head.ljust(128, b"\0") + body + notes


def decode_abif(raw: bytes) -> dict:
    """ABIF: the directory's entries of called bases, their places and qualities, and the four analysed channels in the order FWO_ gives."""
    count, _, at = struct.unpack(">iii", raw[18:30])
    entries: dict[str, bytes] = {}
    kinds: dict[str, tuple[int, int]] = {}
    for i in range(count):
        e = raw[at + 28 * i : at + 28 * i + 28]
        name, number, kind, size, items, length = struct.unpack(">4sihhii", e[:20])
        where = 20 if length <= 4 else struct.unpack(">i", e[20:24])[0]
        data = e[20 : 20 + length] if length <= 4 else raw[where : where + length]
        entries[f"{name.decode('latin-1')}{number}"] = data
        kinds[f"{name.decode('latin-1')}{number}"] = (kind, items)
    shorts = lambda k: np.frombuffer(entries.get(k, b""), ">i2").astype(int).tolist()
    order = entries.get("FWO_1", b"GATC").decode("latin-1")
    channel = {b: shorts(f"DATA{9 + i}") for i, b in enumerate(order)}
    bases = entries.get("PBAS1", b"").decode("latin-1")
    meta = {k: entries[k][1:].decode("latin-1", "replace") for k in ("SMPL1", "MCHN1", "MODL1") if k in entries and kinds[k][0] == 18}
    return {"bases": bases, "quals": list(entries.get("PCON1", bytes(len(bases)))), "basecalls": shorts("PLOC1"), **{b.lower(): channel.get(b, []) for b in CHANNELS}, "metadata": meta}


def read_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, bases, quals, basecalls, a, c, g, t, metadata) of binary trace files."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"file": f, **decode(bytes(c))} for f, c in zip(b["file"], b["content"], strict=True)])

    return files.mapInPandas(run, f"file string, {TRACE}")


def read_phd(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, bases, quals, basecalls) of each whole BEGIN_DNA part of PHD files, of which one file may hold many; a file without any gives one empty row."""
    parts = spark.read.option("lineSep", "BEGIN_DNA").text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"(?s)^\s*\n(.*?)END_DNA", 1).alias("dna"), F.col("value").rlike(r"(?s)^\s*\n(.*?)END_DNA").alias("whole"))
    rows = F.transform(F.filter(F.split("dna", r"\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.split(F.trim(x), r"\s+"))
    each = parts.filter("whole").withColumn("r", rows)
    found = each.select("file", F.array_join(F.transform("r", lambda x: x[0]), "").alias("bases"), F.transform("r", lambda x: x[1].cast("int")).alias("quals"), F.transform("r", lambda x: F.get(x, 2).try_cast("int")).alias("basecalls"))
    none = F.array().cast("array<int>")
    bare = parts.groupBy("file").agg(F.bool_or("whole").alias("whole")).filter("NOT whole").select("file", F.lit("").alias("bases"), none.alias("quals"), none.alias("basecalls"))
    return found.unionByName(bare)


def trim_bounds(quals: Column, *, winsize: int = 10, threshold: int = 20) -> Column:
    """struct<start, stop>: from the first to the end of the last window of winsize qualities all above the threshold; null if there is none. The last window of each direction is not looked at."""
    n = F.size(quals)
    at = F.when(n > winsize, F.sequence(F.lit(0), n - winsize - 1)).otherwise(F.array().cast("array<int>"))
    back = F.when(n > winsize, F.sequence(F.lit(1), n - winsize)).otherwise(F.array().cast("array<int>"))
    good = lambda i: F.array_min(F.slice(quals, i + 1, winsize)) > threshold
    first, last = F.get(F.filter(at, good), 0), F.array_max(F.filter(back, good))
    return F.when(first.isNotNull() & last.isNotNull(), F.struct(first.alias("start"), (last + winsize).alias("stop")))


def trimmed(bases: Column, quals: Column, *, winsize: int = 10, threshold: int = 20, low: int = 25) -> Column:
    """The bases inside trim_bounds, in lower case where the quality is `low` or less."""
    b = trim_bounds(quals, winsize=winsize, threshold=threshold)
    letters = F.transform(F.sequence(b["start"], b["stop"] - 1), lambda i: F.when(F.get(quals, i) <= low, F.lower(F.substring(bases, i + 1, F.lit(1)))).otherwise(F.substring(bases, i + 1, F.lit(1))))
    return F.when(b.isNull(), "").otherwise(F.array_join(letters, ""))


def reverse_complement(df: DataFrame) -> DataFrame:
    """Traces of the other strand: channels swapped and reversed, calls counted from the end."""
    from ..operators.sequence import reverse_complement as rc

    n = F.size("a")
    new = {"bases": rc(F.col("bases"), "standard"), "quals": F.reverse("quals"), "basecalls": F.reverse(F.transform("basecalls", lambda x: n - 1 - x)), "a": F.reverse("t"), "c": F.reverse("g"), "g": F.reverse("c"), "t": F.reverse("a")}
    return df.withColumns(new)


def search(bases: str, pattern: str) -> list[tuple[int, int]]:
    """0-based starts and ends of a regular expression in called bases."""
    return [m.span() for m in re.finditer(pattern, bases)]


def basecall_index(basecalls: list[int], sample: int) -> int:
    """Base whose call lies nearest to a sample."""
    return int(np.argmin(np.abs(np.asarray(basecalls) - sample)))


def insert_base(trace: dict, at: int, base: str, *, qual: int = 0) -> dict:
    """A base put before place `at`, called half way between its neighbours."""
    calls = trace["basecalls"]
    left, right = calls[at - 1] if at else 0, calls[at] if at < len(calls) else calls[-1]
    put = lambda x, v: [*x[:at], v, *x[at:]]
    return trace | {"bases": trace["bases"][:at] + base + trace["bases"][at:], "quals": put(trace["quals"], qual), "basecalls": put(calls, (left + right) // 2)}


def modify_base(trace: dict, at: int, base: str) -> dict:
    return trace | {"bases": trace["bases"][:at] + base + trace["bases"][at + 1 :]}
