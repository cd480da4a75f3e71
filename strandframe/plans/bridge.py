"""Domain frames from the generic tables: sequences, alignments, samples, variants, calls, positions.

Every view exists as Spark SQL and as DuckDB SQL that give the same rows; with_() puts the latter before an oracle query.
Views take whole tables and whole texts. An aligned sequence is the SHA-256 of a name or text, written in bases, so its length
does not cut any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Hexadecimal digits as symbols of an alignment.
HEX = ("0123456789abcdef", "ACGTACGTACGTAN-R")
LETTERS = ("BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACG-T")

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "seqs": (("documents",), f"SELECT doc_id, source, concat('doc', cast(doc_id AS varchar(20))) AS label, translate(upper(regexp_replace(text, '[^A-Za-z]', ''{{g}})), '{LETTERS[0]}', '{LETTERS[1]}') AS seq FROM {{documents}}"),
    "msa": (("documents",), f"SELECT doc_id AS ord, concat('doc', cast(doc_id AS varchar(20))) AS label, concat('-', translate({{sha}}, '{HEX[0]}', '{HEX[1]}'), '--') AS seq FROM {{documents}}"),
    "aligned": (("supplier",), f"SELECT s_suppkey AS ord, s_name AS label, n_name AS grp, concat('-', translate({{sha_name}}, '{HEX[0]}', '{HEX[1]}'), '--') AS seq FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey"),
    "samples": (("supplier", "nation", "region"), "SELECT s_suppkey AS sample_id, n_name AS country, r_name AS pop FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"),
    "variants": (("lineitem",), "SELECT pos, concat('chr', cast(cast(floor(pos / 50) AS int) + 1 AS varchar(9))) AS chrom, substr('ACGT', cast(pos % 4 + 1 AS int), 1) AS ref, substr('ACGT', cast((pos + 1) % 4 + 1 AS int), 1) AS alt1, substr('ACGT', cast((pos + 2) % 4 + 1 AS int), 1) AS alt2, cast(floor(pos / 7) AS int) AS mhapidx FROM (SELECT DISTINCT l_partkey % 200 AS pos FROM {lineitem}) p"),
    "calls": (("lineitem",), "SELECT l_suppkey AS sample_id, l_partkey % 200 AS pos, "
        + ", ".join(f"cast(sum(CASE WHEN l_linenumber % 3 = {i} THEN cast(floor(l_quantity) AS int) ELSE 0 END) AS int) AS ad{i}" for i in range(3))
        + " FROM {lineitem} GROUP BY l_suppkey, l_partkey % 200"),
    "geno": (("calls",), "SELECT sample_id, pos, CASE WHEN ad0 + ad1 < 5 THEN -1 WHEN ad1 / cast(ad0 + ad1 AS double) > cast(0.25 AS double) AND ad1 / cast(ad0 + ad1 AS double) < cast(0.75 AS double) THEN 1 WHEN ad1 / cast(ad0 + ad1 AS double) < cast(0.5 AS double) THEN 0 ELSE 2 END AS nalt FROM {calls}"),
    "genes": (("nation",), "SELECT n_name AS gene, concat('chr', cast(cast(floor(n_nationkey * 8 / 50) AS int) + 1 AS varchar(9))) AS chrom, n_nationkey * 8 AS start_pos, n_nationkey * 8 + 5 AS end_pos FROM {nation}"),
    "pos_a": (("lineitem",), "SELECT DISTINCT l_returnflag AS chrom, l_partkey % 500 AS pos FROM {lineitem} WHERE (l_partkey % 500) % 3 <> 0"),
    "pos_b": (("lineitem",), "SELECT DISTINCT l_returnflag AS chrom, l_partkey % 500 AS pos FROM {lineitem} WHERE (l_partkey % 500) % 2 = 0"),
    "preds": (("labels",), "SELECT doc_id, quality AS truth, toxic AS pred FROM {labels}"),
    "quals": (("events",), "SELECT user_id, event_id AS ord, cast(floor(value) AS int) % 41 AS q FROM {events}"),
}
_NEEDS = {"geno": ("calls",)}
_TABLES = ("documents", "supplier", "nation", "region", "lineitem", "labels", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain frame over the Parquet tables of a directory."""
    _, text = _VIEWS[name]
    args: dict[str, DataFrame] = {}
    for t in _TABLES:
        if f"{{{t}}}" in text:
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for v in _NEEDS.get(name, ()):
        args[v] = view(spark, sf_dir, v)
    text = text.replace("{g}", "").replace("{sha}", "sha2(text, 256)").replace("{sha_name}", "sha2(s_name, 256)")
    return spark.sql(text, **args)


def with_(views: str, sql: str) -> str:
    """DuckDB SQL with the named views (blank-separated) before it."""
    parts, done = [], set()

    def put(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            put(n)
        if name not in done:
            done.add(name)
            text = _VIEWS[name][1].replace("{g}", ", 'g'").replace("{sha}", "sha256(text)").replace("{sha_name}", "sha256(s_name)")
            for t in (*_TABLES, *_VIEWS):
                text = text.replace(f"{{{t}}}", t)
            parts.append(f"{name} AS ({text})")

    for v in views.split():
        put(v)
    more = sql.strip()
    if more.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {more[15:]}"
    return f"WITH {', '.join(parts)}" + (f", {more[5:]}" if more.upper().startswith("WITH ") else f" {more}")
