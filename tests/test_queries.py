"""Every registered query against its SQL on the smallest tables; the commands and the stream run once."""

import os

import duckdb
import pytest

from strandframe import cli
from strandframe.plans import registry
from strandframe.sources import sequences as io
from strandframe.streaming import ingest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, bool | int):
        return int(v)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_linkage_of_all_positions(spark, db):
    from strandframe.operators import popgen
    from strandframe.plans import bridge

    both = "FROM geno x JOIN geno y ON x.sample_id = y.sample_id AND x.pos < y.pos WHERE x.nalt >= 0 AND y.nalt >= 0"
    n, far = db.execute(bridge.with_("geno", f"SELECT count(DISTINCT (x.pos, y.pos)), max(y.pos - x.pos) {both}")).fetchone()
    got = registry.queries()["POP03_ld"](spark, DATA)
    assert tuple(got.selectExpr("count(*)", "max(q - p)").first()) == (n, far) and far > 10
    # Small blocks, and bins of neighbours, give the same pairs.
    rows = {(r["p"], r["q"]): r["r2"] for r in got.collect()}
    geno = bridge.view(spark, DATA, "geno")
    for kw in ({"size": 7}, {"max_distance": 10}):
        part = {(r["p"], r["q"]): r["r2"] for r in popgen.ld(geno, **kw).collect()}
        want = {k: v for k, v in rows.items() if k[1] - k[0] <= kw.get("max_distance", far)}
        assert part.keys() == want.keys() and all(a == want[k] or abs(a - want[k]) < 1e-5 for k, a in part.items())


def test_commands(spark, tmp_path):
    f = tmp_path / "a.fasta"
    f.write_text(">x 1999\nACGTNN\n>y\nACG\n>x\nTT\n")
    cli.main(["readseq", str(f), "-o", str(tmp_path / "o"), "--minlen", "3", "--sort", "len"], spark)
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == [">x", "ACGTNN", ">y", "ACG"]
    cli.main(["statseq", str(f), "-o", str(tmp_path / "s.tsv")], spark)
    assert spark.read.csv(str(tmp_path / "s.tsv"), sep="\t", header=True).count() == 3
    cli.main(["deduplicate", str(f), "-o", str(tmp_path / "d")], spark)
    assert spark.read.text(str(tmp_path / "d")).count() == 4


def test_more_commands(spark, tmp_path, capsys):
    ref = "ACGTTGCATTGACCAGTTACGGATCCATGCAACTTGGACCTTAGCAATCGGAGTCA"
    (tmp_path / "r.fasta").write_text(f">r\n{ref}\n")
    (tmp_path / "c.fasta").write_text(f">a\n{ref[20:]}{ref[:20]}\n>b\n{ref}\n")
    cli.main(["recircularize2", str(tmp_path / "c.fasta"), "--reference", str(tmp_path / "r.fasta"), "-o", str(tmp_path / "o")], spark)
    assert {r["label"]: r["seq"] for r in io.read_fasta(spark, str(tmp_path / "o")).collect()} == {"a": ref, "b": ref}
    cli.main(["showcmds"], spark)
    assert "recircularize2\t" in capsys.readouterr().out
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    for name, cell in (("s1", "0/0"), ("s2", "0/1")):
        (tmp_path / f"{name}.vcf").write_text(f"{head}{name}\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t{cell}\n")
    files = [str(tmp_path / f"{n}.vcf") for n in ("s1", "s2")]
    cli.main(["vcf2table", *files, "-o", str(tmp_path / "v")], spark)
    assert {r["sample"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"s1", "s2"}
    cli.main(["vcf2qc", *files, "-o", str(tmp_path / "q.tsv")], spark)
    assert spark.read.csv(str(tmp_path / "q.tsv"), sep="\t", header=True).count() == 2


def test_ranges_hold_alike_many_rows(spark):
    from pyspark.sql import functions as F

    from strandframe.operators.sequence import in_ranges, numbered

    # Nearly all values lie close together, some far away.
    df = spark.range(20000).select(F.when(F.col("id") % 1000 == 0, F.col("id") * 10**9).otherwise(F.col("id")).alias("v"))
    sizes = [r["count"] for r in in_ranges(df, "v", 500).groupBy("__part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 1500
    got = numbered(df, "v").orderBy("v").collect()
    assert [r["number"] for r in got] == list(range(1, 20001))


def test_map_traces(spark, tmp_path):
    from strandframe.sources import traces

    ref = "ACGTTGCATTGACCAGTTACGGATCCATGCAACTTGGACCTTAGCAATCGGA"
    n = len(ref)
    (tmp_path / "t.scf").write_bytes(traces.encode_scf(ref, [40] * n, list(range(n)), [[1] * n] * 4, {}))
    (tmp_path / "r.fasta").write_text(f">r\n{ref}\n")
    cli.main(["mapread", str(tmp_path / "t.scf"), "--reference", str(tmp_path / "r.fasta"), "-o", str(tmp_path / "m.tsv")], spark)
    row = spark.read.csv(str(tmp_path / "m.tsv"), sep="\t", header=True).first()
    assert row["strand"] == "+" and row["start"] == "0"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("x\tAACG-\ny\tN\n")
    q = ingest.running_composition(ingest.flat_sequences(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("composition").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("composition").first().asDict() == {"n_a": 2, "n_c": 1, "n_g": 1, "n_t": 0, "n_n": 1, "n_gap": 1}
