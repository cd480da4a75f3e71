import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions.alphabet import codons, nucleotide_scores
from strandframe.operators import align, profile
from strandframe.operators import sequence as sq
from strandframe.sources import sequences as io


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ACGTRYKMSWBDHVN-", max_size=40))
def test_reverse_complement_twice_is_identity_by_the_standard(spark, seq):
    twice = sq.reverse_complement(sq.reverse_complement(F.col("s"), "standard"), "standard")
    assert one(spark, twice, s=seq) == seq


def test_compat_complement_breaks_v_and_keeps_s_w_swapped(spark):
    assert one(spark, sq.complement(F.col("s")), s="VSWBv") == "GWSVg"


def test_translation_drops_the_last_codon_unless_asked(spark):
    assert one(spark, sq.translate(F.col("s")), s="ATGCCGTCN") == "ML"
    assert one(spark, sq.translate(F.col("s"), include_last=True), s="ATGCCGTCN") == "MLT"
    assert one(spark, sq.translate(F.col("s"), include_last=True, table="standard"), s="ATGCCGTCN") == "MPS"
    assert one(spark, sq.translate(F.col("s")), s="AT") == ""
    assert one(spark, sq.translate(F.col("s")), s="ATGTAAATGAAAA") == "M"


def test_codon_tables_agree_but_for_the_known_codons():
    a, b = codons("compat"), codons("standard")
    assert {k for k in a if k in b and a[k] != b[k]} == {"CCG", "TCN", "TCM", "TCR", "TCW", "TCS", "TCY", "TCK", "TCV", "TCH", "TCD", "TCB"}


def test_relative_positions_of_a_gapped_sequence(spark):
    df = spark.createDataFrame([("-AC--G",)], ["s"]).select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p"), "s")
    assert [r[0] for r in df.select(sq.relative_position(F.col("s"), F.col("p"))).collect()] == [-1, 0, 1, 1, 1, 2]
    assert one(spark, sq.absolute_position(F.col("s"), 2), s="-AC--G") == 5
    assert one(spark, sq.absolute_position(F.col("s"), 3), s="-AC--G") is None


def test_haplotype_codes_round_trip(spark):
    assert one(spark, sq.encode_haplotype(F.col("s")), s="-ACGT") == 194
    assert one(spark, sq.decode_haplotype(F.lit(194), 5), s="") == "-ACGT"


def test_sites_with_ambiguity_and_last_offset(spark):
    got = one(spark, sq.restriction_sites(F.col("s"), "GRT", inclusive=True), s="GATGGT")
    assert [tuple(r) for r in got] == [(0, 0), (3, 0)]
    assert [r["pos"] for r in one(spark, sq.restriction_sites(F.col("s"), "GRT"), s="GATGGT")] == [0]


def test_shrink_gaps_looks_at_column_zero_unless_compat(spark):
    df = spark.createDataFrame([(0, "-A-C"), (1, "-AGC")], "ord long, seq string")
    assert {r["seq"] for r in sq.shrink_gaps(df).collect()} == {"A-C", "AGC"}
    assert {r["seq"] for r in sq.shrink_gaps(df, compat=True).collect()} == {"-A-C", "-AGC"}


def test_condense_ignores_case_and_n(spark):
    df = spark.createDataFrame([(0, "ACGTA"), (1, "aCNTC"), (2, "ACGTG")], "ord long, seq string")
    kept, positions = sq.condense(df)
    assert {r["seq"] for r in kept.collect()} == {"A", "C", "G"} and [r[0] for r in positions.collect()] == [5]


def test_dereplicate_and_deduplicate_keep_the_first(spark):
    df = spark.createDataFrame([(0, "a", "AC"), (1, "b", "AC"), (2, "a", "GG")], "ord long, label string, seq string")
    assert {(r["label"], r["n"]) for r in sq.dereplicate(df).collect()} == {("a#b", 2), ("a", 1)}
    assert {(r["ord"], r["label"]) for r in sq.deduplicate(df).collect()} == {(0, "a"), (1, "b")}


def test_relabel_does_not_cut_long_numbers(spark):
    df = spark.range(12).select((F.col("id") * 1000).alias("ord"), F.lit("x").alias("label"))
    assert [r["new_label"] for r in sq.relabel(df).orderBy("ord").collect()][:2] == ["0001", "0002"]


def test_consensus_options(spark):
    df = spark.createDataFrame([(0, "AC-"), (1, "AG-"), (2, "AGT")], "ord long, seq string")
    p = profile.fit(df)
    assert profile.consensus(p, (0.5, 0.8)).orderBy("threshold").collect()[1]["consensus"] == "Ag-"
    assert profile.consensus(p, (0.5,), synthetic=True).first()["consensus"] == "AGT"
    assert profile.consensus(p, (0.5,), reference="AC-").first()["consensus"] == ".G."
    with pytest.raises(Exception, match="unknown symbol"):
        profile.fit(spark.createDataFrame([(0, "A!")], "ord long, seq string")).collect()


def test_fasta_reader(spark, tmp_path):
    f = tmp_path / "tiny.fasta"
    f.write_text(">a [k=v; k2=v2; flag] some text\nAC GT\n\nTT\n>@@pos\n1,2\n>b\n" + "A" * 250 + "\n>@ext\nxy\n")
    got = io.read_fasta(spark, str(f)).orderBy("ord").collect()
    assert [(r["label"], r["seq"], r["definition"]) for r in got] == [("a", "ACGTTT", "some text"), ("b", "A" * 250, "")]
    assert got[0]["attr"] == {"k": "v", "k2": "v2"}
    assert [r["label"] for r in io.read_fasta(spark, str(f), keep="controls").collect()] == ["pos"]
    assert [(r["owner"], r["label"], r["seq"]) for r in io.read_fasta(spark, str(f), keep="extra").collect()] == [("b", "ext", "xy")]
    out = str(tmp_path / "out")
    io.write_fasta(io.read_fasta(spark, str(f)), out)
    text = "\n".join(r[0] for r in spark.read.text(out).collect())
    assert ">a [k=v; k2=v2]" in text and max(map(len, text.splitlines())) == 120


def test_fastq_with_a_quality_line_that_starts_with_at(spark):
    text = "@r1 x\nACG\nT\n+\n@III\n>f\nAC\n@r2\nAA\n+\nI"
    assert list(io.fastq_entries(text)) == [("r1", "ACGT", "@III"), ("f", "AC", None), ("r2", "AA", None)]


def test_genbank_and_embl(spark, tmp_path):
    g = tmp_path / "tiny.gb"
    g.write_text(
        "LOCUS       X1 6 bp\nDEFINITION  a virus,\n            complete\nACCESSION   X1\nFEATURES             Location/Qualifiers\n"
        '     source          1..6\n                     /organism="A b"\n                     /isolate="i 1"\n     CDS             1..3\n                     /note="two\n                     lines"\n'
        "ORIGIN\n        1 acgtac\n//\nLOCUS       X2\nACCESSION   X2\nORIGIN\n        1 gg\n//\n"
    )
    a, b = io.read_genbank(spark, str(g)).orderBy("ord").collect()
    assert (a["label"], a["seq"], a["definition"], a["attr"]) == ("X1", "acgtac", "a virus, complete", {"organism": "A b", "isolate": "i 1"})
    assert a["features"][1]["location"] == "1..3" and a["features"][1]["fields"]["note"] == ["two lines"] and b["seq"] == "gg"
    assert list(io.embl_entries("ID   E1; SV 1;\nSQ   Sequence\n     acgt ac 6\n//\n")) == [("E1", "acgtac")]


def test_nexus_round_trip():
    rows = [("a", "AC-T"), ("b", "ACGT")]
    assert list(io.nexus_entries(io.nexus_text(rows))) == rows


BLOSUM_PART = {("W", "W"): 11.0, ("E", "E"): 5.0, ("W", "E"): -3.0, ("E", "W"): -3.0}


def test_global_alignment_puts_the_gap_inside():
    r = align.align_pair("WW", "WEW", method="global", matrix=BLOSUM_PART)
    assert (r["x"], r["y"]) == ("W-W", "WEW")
    r = align.align_pair("WEW", "WW", method="global", matrix=BLOSUM_PART)
    assert (r["x"], r["y"]) == ("WEW", "W-W")


@pytest.mark.parametrize("method", ["global", "global_cfe"])
def test_alignments_without_gaps_are_the_input(method):
    x, y = "ACGTACGTTGCA", "ACGTCGTTGCAGG"
    r = align.align_pair(x, y, method=method)
    assert r["x"].replace("-", "") == x and r["y"].replace("-", "") == y and len(r["x"]) == len(r["y"])


def test_local_and_contained_reads():
    assert align.align_pair("TTTTACGTACGTTTT", "GGACGTACGGG", method="local")["x"] == "ACGTACG"
    assert align.map_read("GATTACA", "CCCCGATTACACCCC") == {"start": 4, "end": 11, "mismatches": 0, "inserts": 0, "dels": 0}
    assert align.map_read("GATTACA", "CCCCCCCCCCCC") is None


def test_scores_follow_the_rule():
    s = nucleotide_scores()
    assert [s["A", x] for x in "ATSWRVHN"] == [5, -4, -4, 1, 1, -1, -1, -2] and s["S", "H"] == -3 and s["N", "R"] == -1
    assert nucleotide_scores(read=True)["A", "N"] == 0


def test_pairs_of_many_lengths_align_together_as_alone():
    import random

    from strandframe.operators import align

    rng = random.Random(2)
    seq = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    xs = [seq(rng.randrange(0, 30)) for _ in range(120)]
    ys = [x[3:15] + seq(rng.randrange(0, 9)) if rng.random() < 0.7 else seq(rng.randrange(0, 30)) for x in xs]
    for method in align.METHODS:
        for gaps in ((-7.0, -7.0, -7.0), (-10.0, -1.0, -4.0)):
            assert align.align_pairs(xs, ys, method=method, gaps=gaps) == [align.align_pair(x, y, method=method, gaps=gaps) for x, y in zip(xs, ys, strict=True)]
    ref = seq(60)
    circles = [ref[k:] + ref[:k] for k in range(0, 60, 7)] + [seq(4), ref[:30]]
    assert align.recircularise_each(circles, ref) == [align.recircularise(c, ref) for c in circles]
    assert align.recircularise_each_by(circles, [ref] * len(circles)) == [align.recircularise_by(c, ref) for c in circles]
    assert align.map_reads(circles, [ref] * len(circles)) == [align.map_read(c, ref) for c in circles]


def test_rows_of_one_file_are_aligned_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from strandframe.operators import align

    df = spark.createDataFrame([(f"s{i}", "ACGTTGCATTGACCAGTTACGGATCCATGCAACTTGGACC"[i % 9 :], "ACGTTGCATTGACCAGTTACGGATCCATG") for i in range(64)], "label string, seq string, other string").coalesce(1)
    for got in (
        align.align_columns(df, "seq", "other"), align.map_columns(df, "other", "seq"), align.both_strands_columns(df, "other", "seq"), align.recircularise_columns(df, "seq", "other"),
        align.recircularise_all(df, "ACGTTGCATTGACCAGTTACGGATCCATGCAACTTGGACC"),
    ):
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 3 and max(r["count"] for r in tasks) < 30


def test_matrix_of_more_samples_than_a_plan_holds_columns(spark):
    from pyspark.sql import functions as F

    from strandframe.sources import variants

    n = 30000
    df = spark.range(n).filter("id % 7 <> 3").select((F.col("id") % 3).alias("pos"), F.col("id").alias("s"), F.when(F.col("id") % 5 > 0, (F.col("id") % 4).cast("int")).alias("v"))
    rows, names = variants.strips(df, "pos", "s", "v", width=1000)
    ids = [i for i in range(n) if i % 7 != 3]
    assert [x for r in names.orderBy("strip").collect() for x in r["names"]] == ids
    assert {len(r["cells"]) for r in rows.collect()} == {1000, len(ids) % 1000 or 1000}
    got = variants.unpivot_strips(rows, names, "pos")
    assert got.count() == 3 * len(ids)
    assert {tuple(r) for r in got.filter("gt IS NOT NULL").collect()} == {(i % 3, str(i), i % 4) for i in ids if i % 5}


def test_phd_file_of_many_records(spark, tmp_path):
    from strandframe.sources import traces

    one = "BEGIN_SEQUENCE s{0}\nBEGIN_COMMENT\nx\nEND_COMMENT\n\nBEGIN_DNA\na {0} 5\nc 2\n\nEND_DNA\n\nEND_SEQUENCE\n"
    (tmp_path / "ball.phd").write_text("".join(one.format(i) for i in range(300)))
    (tmp_path / "none.phd").write_text("BEGIN_SEQUENCE x\nEND_SEQUENCE\n")
    (tmp_path / "cut.phd").write_text("BEGIN_DNA\na 1 5\n")
    rows = traces.read_phd(spark, str(tmp_path)).collect()
    assert sorted(r["quals"][0] for r in rows if r["bases"] == "ac" and r["quals"][1] == 2 and r["basecalls"] == [5, None]) == list(range(300))
    assert sorted(r["file"].rsplit("/", 1)[1] for r in rows if r["bases"] == "" and r["quals"] == []) == ["cut.phd", "none.phd"] and len(rows) == 302


def test_records_of_one_genbank_file_are_read_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    text = 'LOCUS       r{0} 4 bp\nFEATURES             Location/Qualifiers\n     source          1..4\n                     /isolate="a // {0}"\nORIGIN\n        1 acgt\n//\n'
    (tmp_path / "x.gb").write_text("".join(text.format(i) for i in range(4000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = io.read_genbank(spark, str(tmp_path / "x.gb"))
        assert got.select(F.spark_partition_id()).distinct().count() > 4
        assert [(r["label"], r["seq"], r["attr"]["isolate"]) for r in got.orderBy("ord").collect()] == [(f"r{i}", "acgt", f"a // {i}") for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_vcf_cells_leave_the_line_and_its_folder(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandframe.sources import variants

    names = [f"s{i}" for i in range(500)]
    (tmp_path / "0.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names) + "\n")
    (tmp_path / "1.vcf").write_text("".join(f"c\t{p}\t.\tA\tC\t.\t.\t.\tGT:DP\t" + "\t".join(f"0/1:{p + i}" for i in range(500)) + "\n" for p in range(40)))
    c = variants.read_vcf(spark, str(tmp_path))[1]
    assert {(r["sample"], r["pos"], r["dp"]) for r in c.collect()} == {(n, p, p + i) for i, n in enumerate(names) for p in range(40)}
    # No row has the fields of its whole line beside it, and lines of one folder are not one task.
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(cells" in plan
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert c.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
