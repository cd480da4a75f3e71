import struct

import numpy as np
from pyspark.sql import functions as F

from strandframe.operators import assign, calls, popgen, positions
from strandframe.sources import traces, trees, variants


def test_or_rule_finds_at_least_the_hets_of_the_and_rule(spark):
    df = spark.createDataFrame([([a, b, 0],) for a in range(0, 12) for b in range(0, 12)], "ad array<int>")
    c, d = calls.call(F.col("ad")), calls.call(F.col("ad"), het_rule="and")
    rows = df.select(c["het"].alias("o"), d["het"].alias("a"), calls.call(F.col("ad"), hetratio=-1, minaltdepth=-1)["het"].alias("m")).collect()
    assert all(r["o"] or not r["a"] for r in rows) and any(r["o"] and not r["a"] for r in rows) and not any(r["m"] for r in rows)


def test_vcf_reader(spark, tmp_path):
    f = tmp_path / "tiny.vcf"
    f.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tC,G\t.\tPASS;q10\tDP=3;DB\tGT:AD\t./.:.\t0|1:2,3,.\n10\t7\trs1\tAT\tA\t9\t.\t.\tGT\t1\t0/1\n")
    v, c = variants.read_vcf(spark, str(f))
    a, b = v.orderBy("pos").collect()
    assert (a["id"], a["alts"], a["filter"], a["info"]["DP"]) == (None, ["C", "G"], "PASS;q10", "3") and (b["id"], b["qual"], b["filter"]) == ("rs1", 9.0, None)
    got = {(r["pos"], r["sample"]): (r["gt"], r["ad"], r["phased"]) for r in c.collect()}
    assert got[5, "s1"] == ([-1, -1], [None], False) and got[5, "s2"] == ([0, 1], [2, 3, None], True) and got[7, "s1"][0] == [1]
    assert variants.read_vcf(spark, str(f), chroms=["1"])[0].count() == 1
    assert calls.no_indels(v).count() == 1 and calls.exclude_keywords(v, ["q10"]).count() == 1


def test_vcf_files_of_different_samples(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    paths = []
    for name, samples, cells in (("a", "s1", "0/0"), ("b", "s2\ts3", "1/1\t0|1")):
        (tmp_path / f"{name}.vcf").write_text(f"{head}{samples}\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t{cells}\n")
        paths.append(str(tmp_path / f"{name}.vcf"))
    got = {(r["sample"], tuple(r["gt"])) for r in variants.read_vcf(spark, paths)[1].collect()}
    assert got == {("s1", (0, 0)), ("s2", (1, 1)), ("s3", (0, 1))}


def test_sequence_type_takes_three_and_counts_no_n(spark):
    from strandframe.operators.sequence import sequence_type

    of = lambda *seqs: sequence_type(spark.createDataFrame(list(enumerate(seqs)), "ord long, seq string")).first()[0]
    assert of("NNNNNNNNAC", "ACGT", "NNNNNNNNNN") == "PROTEIN"
    assert of("ACGT", "MKVL", "ACGA", "acgt") == "DNA" and of("ACGU", "ACGU") == "RNA" and of("--", "~") == "PROTEIN" and of("ACG") == "RNA"
    assert sequence_type(spark.createDataFrame([], "ord long, seq string")).first()[0] == "DNA"


def test_windows_that_cross_bins(spark):
    pos = [1, 2, 3, 9, 10, 11, 12, 30, 31, 45, 46, 47, 48, 49]
    got = positions.sliding_windows(spark.createDataFrame([("c", p) for p in pos], "chrom string, pos long"), size=10).collect()
    want, edge = set(), None
    for p in pos:
        w = [q for q in pos if p <= q <= p + 10]
        if len(w) >= 3 and (edge is None or w[-1] > edge):
            want.add((p, w[-1], len(w)))
            edge = w[-1]
    assert {(r["first"], r["last"], r["n"]) for r in got} == want


def test_pruning_over_a_chain_of_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (40, 1))
    geno = [(s, p, int(v)) for p in range(12) for s, v in enumerate(np.where(rng.random((40, 1)) < 0.15 * (p % 4), rng.integers(0, 3, (40, 1)), x)[:, 0])]
    df = spark.createDataFrame(geno, "sample_id long, pos long, nalt int")
    scores = spark.createDataFrame([(p, float(p * 7 % 5), "c") for p in range(12)], "pos long, score double, chrom string")
    r2 = {frozenset((r["p"], r["q"])): r["r2"] or 0 for r in popgen.ld(df).collect()}
    kept: list[int] = []
    for p in sorted(range(12), key=lambda p: (-(p * 7 % 5), p)):
        if all(r2[frozenset((p, q))] < 0.5 for q in kept):
            kept.append(p)
    assert {r["pos"] for r in popgen.prune(df, scores, r2=0.5).collect()} == set(kept) and len(kept) < 12


def test_position_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("CHROM\tPOS\tGENE\nc1\t5\tx\n# note\nc2\t7\ty\n")
    got = variants.read_positions(spark, str(tmp_path / "p.txt")).orderBy("pos").collect()
    assert [(r["chrom"], r["pos"], r["gene"], r["length"]) for r in got] == [("c1", 5, "x", 1), ("c2", 7, "y", 1)]
    (tmp_path / "r.bed").write_text("c1\t4\t5\nc1\t4\t9\n")
    assert sorted((r["end"], r["pos"]) for r in variants.read_positions(spark, str(tmp_path / "r.bed")).collect()) == [(5, 5), (9, None)]


def test_set_identities(spark):
    a = spark.createDataFrame([("c", i) for i in (1, 2, 3)], "chrom string, pos long")
    b = spark.createDataFrame([("c", i) for i in (3, 4)], "chrom string, pos long")
    n = lambda df: sorted(r["pos"] for r in df.collect())
    assert n(positions.union(a, b)) == [1, 2, 3, 4] and n(positions.symmetric_difference(a, b)) == [1, 2, 4]
    assert n(positions.symmetric_difference(a, b, compat=True)) == n(positions.difference(a, b)) == [1, 2]


def test_mhap_codes_with_single_and_repeated_index(spark):
    df = spark.createDataFrame([("c1", 1, 7), ("c1", 3, 7), ("c1", 9, 8), ("c2", 12, 7)], "chrom string, pos long, mhapidx int")
    assert [r["code"] for r in positions.mhap_codes(df).orderBy("run").collect()] == ["c1:1:2", "c1:9", "c2:12"]


def test_packed_distances_come_back(spark):
    df = spark.createDataFrame([(d, n) for n in range(0, 30) for d in range(0, n + 1)], "d long, n long")
    u = popgen.unpacked(popgen.packed(F.col("d"), F.col("n")))
    assert df.filter((u["diff"] != F.col("d")) | (u["n"] != F.col("n"))).count() == 0


def test_pair_counts_in_small_blocks_equal_plain_counts(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-1, 3, (23, 17))
    df = spark.createDataFrame([(i, j, int(m[i, j])) for i in range(23) for j in range(17)], "sample_id long, pos long, nalt int")
    got = {(r["i"], r["j"]): (r["diff"], r["n"]) for r in popgen.pair_counts(df, id="sample_id", col="pos", value="nalt", missing=[-1], size=5).collect()}
    want = {(i, j): (int(((m[i] >= 0) & (m[j] >= 0) & (m[i] != m[j])).sum()), int(((m[i] >= 0) & (m[j] >= 0)).sum())) for i in range(23) for j in range(i + 1, 23)}
    assert got == want


def test_group_distances_in_blocks_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    m = np.repeat(rng.integers(-1, 3, (20, 6)), [1, 2, 3, 1] * 5, axis=0)
    m[-1] = -1  # shares no position with anyone
    m[0, :3], m[1, 3:] = -1, -1
    df = spark.createDataFrame([(i, j, int(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "sample_id long, pos long, nalt int")
    groups = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(len(m))], "sample_id long, grp string")
    pairs = popgen.genotype_distance(df)
    assert pairs.filter("n = 0").count()
    want = {(r["g1"], r["g2"]): r["dxy"] for r in popgen.dxy(pairs.filter("n > 0"), groups).collect()}
    for size in (None, 4):
        got = {(r["g1"], r["g2"]): r["dxy"] for r in popgen.genotype_dxy(df, groups, size=size).collect()}
        assert got.keys() == want.keys() and all(abs(x - want[k]) < 1e-12 for k, x in got.items())


def test_group_distances_send_no_pairs_out(spark):
    """All pairs of 4,000 samples are eight million rows; what leaves the blocks are sums of groups."""
    df = spark.range(4000).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("pos"))
    df = df.withColumn("nalt", F.pmod(F.xxhash64("sample_id", "pos"), F.lit(3)).cast("int"))
    got = popgen.genotype_dxy(df, spark.range(4000).select(F.col("id").alias("sample_id"), (F.col("id") % 2).alias("grp")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") == 0
    d = {(r["g1"], r["g2"]): r["dxy"] for r in got.collect()}
    assert len(d) == 4 and d[0, 1] == d[1, 0] and abs(d[0, 0] - 2 / 3) < 0.01


def test_net_distances_read_the_group_distances_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    rows = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 4.0), ("b", "a", 4.0), ("b", "b", 2.0)], "g1 string, g2 string, dxy double")
    got = {(r["g1"], r["g2"]): r["da"] for r in popgen.da(rows.mapInPandas(seen, rows.schema)).collect()}
    assert got == {("a", "a"): 0.0, ("a", "b"): 2.5, ("b", "a"): 2.5, ("b", "b"): 0.0} and runs.value == 4


def test_newick_distances(spark):
    nodes = trees.parse_newick("((a:1,b:2):3,(c:4,d:5)x:6);")
    got = {(r["i"], r["j"]): r["d"] for r in popgen.patristic(trees.ancestors(spark, nodes)).collect()}
    assert got[("a", "b")] == 3 and got[("a", "c")] == 14 and got[("c", "d")] == 9


def _tree(spark, n: int, of: int = 7):
    rng = np.random.default_rng(n)
    rows = [(i, f"n{i % of}", float(rng.integers(1, 4))) for i in range(n)] + [(i, f"r{i % of % 2}", float(rng.integers(3, 6))) for i in range(n)] + [(i, "root", float(rng.integers(5, 9))) for i in range(n - 2)]
    return spark.createDataFrame(rows, "leaf long, ancestor string, dist double"), rows


def test_leaves_in_small_blocks(spark):
    df, rows = _tree(spark, 23)
    want = {}
    for a, x, u in rows:
        for b, y, v in rows:
            if a < b and x == y:
                want[a, b] = min(want.get((a, b), 99), u + v)
    got = popgen.patristic(df, size=5)
    assert {(r["i"], r["j"]): r["d"] for r in got.collect()} == want and len(want) == got.count()


def test_nearest_leaves_equal_those_of_all_pairs(spark):
    for n, k in ((23, 3), (40, 5), (4, 9)):
        df, _ = _tree(spark, n)
        p = [(r["i"], r["j"], r["d"]) for r in popgen.patristic(df).collect()]
        both = sorted((i, d, j) for i, j, d in p + [(j, i, d) for i, j, d in p])
        want = {(i, j, d) for at, (i, d, j) in enumerate(both) if sum(x[0] == i for x in both[:at]) < k}
        assert {tuple(r) for r in popgen.nearest(df, k).collect()} == want


def test_nearest_leaves_make_no_pairs_of_leaves(spark):
    """Thirty thousand leaves have 450 million pairs."""
    df = spark.range(30000).select(F.col("id").alias("leaf"), F.lit("root").alias("ancestor"), (F.col("id") % 3 + 1.0).alias("dist"))
    got = popgen.nearest(df, 2)
    assert got.filter("d <> 1.0 + i % 3 + 1").count() == 0 and got.count() == 60000


def test_pairs_of_a_large_group_lie_in_many_tasks(spark):
    df = spark.range(900).select(F.col("id").alias("s"), F.when(F.col("id") % 9 > 0, "x").otherwise("y").alias("pop"))
    got = positions.pairs_within(df, "pop", "s", size=100)
    want = {("x", i, j) for i in range(900) for j in range(i + 1, 900) if i % 9 and j % 9} | {("y", i, j) for i in range(0, 900, 9) for j in range(i + 9, 900, 9)}
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(want) / 5


def test_linkage_in_parts_of_samples(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(-1, 3, (40, 12))
    df = spark.createDataFrame([(s, 3 * p, int(v), "ab"[p % 2]) for s, r in enumerate(m) for p, v in enumerate(r)], "sample_id long, pos long, nalt int, chrom string")

    def want(p, q):
        met = (m[:, p] >= 0) & (m[:, q] >= 0)
        return np.corrcoef(m[met, p], m[met, q])[0, 1] ** 2

    for kw in ({}, {"samples": 7}, {"samples": 7, "size": 5}, {"group": "chrom", "samples": 9}, {"max_distance": 9, "samples": 11, "size": 2}):
        got = {(r["p"] // 3, r["q"] // 3): r["r2"] for r in popgen.ld(df, **kw).collect()}
        keys = {(p, q) for p in range(12) for q in range(p + 1, 12) if ("group" not in kw or p % 2 == q % 2) and 3 * (q - p) <= kw.get("max_distance", 99)}
        assert got.keys() == keys and all(abs(v - want(*k)) < 1e-9 for k, v in got.items())


def test_linkage_holds_a_part_of_the_samples_at_a_time(spark):
    """No group of rows that Python gets at once has more than a block of positions of one part of the samples."""
    df = spark.range(3000).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("pos"))
    df = df.withColumn("nalt", F.pmod(F.xxhash64("sample_id", "pos"), F.lit(3)).cast("int"))
    seen, own = [], popgen.pack
    popgen.pack = lambda laid, by, body: seen.append(laid.groupBy(*by).count().agg(F.max("count")).first()[0]) or own(laid, by, body)
    try:
        assert popgen.ld(df, samples=100).count() == 45
    finally:
        popgen.pack = own
    assert seen[0] < 10 * 200


def test_guide_tree_nodes():
    assert assign.tree_nodes(trees.parse_guide_tree("[[A, B], C]")) == [("n", ["A", "B"], ["C"]), ("n0", ["A"], ["B"])]


def test_score_matrix_text():
    assert trees.parse_scores("# x\n  A C\nA 1 -2\nC -2 3\n")["A", "C"] == -2


def test_scf_round_trip_and_prefix():
    ch = [[5, 9, 2, 7, 1], [0, 1, 2, 3, 4], [9, 9, 9, 9, 9], [100, 3, 65000, 2, 1]]
    raw = traces.encode_scf("ACG", [10, 20, 30], [0, 2, 4], ch, {"NAME": "x"})
    for data in (raw, b"\0" * 128 + raw):
        t = traces.decode(data)
        assert (t["bases"], t["quals"], t["basecalls"], t["metadata"]) == ("ACG", [10, 20, 30], [0, 2, 4], {"NAME": "x"})
        assert [t[c] for c in "acgt"] == ch


def test_abif():
    entries = [(b"PBAS", 1, 2, 1, b"ACGTA"), (b"PLOC", 1, 4, 2, struct.pack(">5h", 1, 2, 3, 4, 5)), (b"PCON", 1, 2, 1, bytes([9, 8, 7, 6, 5])), (b"FWO_", 1, 2, 1, b"GATC")]
    entries += [(b"DATA", 9 + i, 4, 2, struct.pack(">3h", i, i, i)) for i in range(4)]
    body, directory = b"", b""
    for name, number, kind, size, data in entries:
        where = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">i", 128 + len(body))
        body += data if len(data) > 4 else b""
        directory += struct.pack(">4sihhii", name, number, kind, size, len(data) // size, len(data)) + where + bytes(4)
    head = b"ABIF" + struct.pack(">h4sihhiii", 101, b"tdir", 1, 1023, 28, len(entries), len(directory), 128 + len(body))
    t = traces.decode(head.ljust(128, b"\0") + body + directory)
    assert (t["bases"], t["basecalls"], t["quals"], t["g"], t["c"]) == ("ACGTA", [1, 2, 3, 4, 5], [9, 8, 7, 6, 5], [0, 0, 0], [3, 3, 3])


def test_trimming_and_editing(spark):
    df = spark.createDataFrame([("ACGTACGT", [1, 30, 30, 26, 24, 30, 30, 1])], "b string, q array<int>")
    assert df.select(traces.trimmed(F.col("b"), F.col("q"), winsize=2, threshold=20)).first()[0] == "CGTaCG"
    t = {"bases": "AC", "quals": [5, 6], "basecalls": [10, 20]}
    assert traces.insert_base(t, 1, "G") == {"bases": "AGC", "quals": [5, 0, 6], "basecalls": [10, 15, 20]} and traces.modify_base(t, 0, "T")["bases"] == "TC"
    assert traces.basecall_index([10, 20, 30], 24) == 1 and traces.search("ACGACG", "CG") == [(1, 3), (4, 6)]


def test_runs_over_many_ranges_equal_a_plain_pass(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vals = [None if x == 3 else int(x) for x in np.repeat(rng.integers(0, 4, 80), rng.integers(1, 5, 80))]
    keys = np.cumsum(rng.integers(1, 9, len(vals))).tolist()
    small = positions.in_ranges
    monkeypatch.setattr(positions, "in_ranges", lambda df, by: small(df, by, rows=7))
    df = spark.createDataFrame(list(zip(keys, vals, strict=True)), "pos long, v int").repartition(3)
    got = [r["run"] for r in positions.runs(df, F.col("v"), "pos").orderBy("pos").collect()]
    want = [0]
    for a, b in zip(vals, vals[1:], strict=False):
        want.append(want[-1] + (a != b))
    assert got == want


def test_alignment_scores_equal_plain_recurrences():
    from strandframe.operators import align

    rng = np.random.default_rng(6)
    table = align._table(align.nucleotide_scores())
    for gaps in ((-7.0, -7.0, -7.0), (-10.0, -1.0, -10.0), (-4.0, -6.0, -5.0)):
        opening, extend, double = gaps
        for method in align.METHODS:
            x, y = ("".join(rng.choice(list("ACGT"), n)) for n in rng.integers(5, 14, 2))
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            s = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
            up, left = ([[-1e30] * (len(y) + 1) for _ in range(len(x) + 1)] for _ in range(2))
            for i in range(1, len(x) + 1):
                s[i][0] = opening + extend * (i - 1) if method == "global" else 0.0
            for j in range(1, len(y) + 1):
                s[0][j] = opening + extend * (j - 1) if method in ("global", "glocal") else 0.0
            for i in range(1, len(x) + 1):
                up[i][0] = max(s[i - 1][0] + opening, up[i - 1][0] + extend, left[i - 1][0] + double)
                for j in range(1, len(y) + 1):
                    up[i][j] = max(s[i - 1][j] + opening, up[i - 1][j] + extend, left[i - 1][j] + double)
                    left[i][j] = max(s[i][j - 1] + opening, left[i][j - 1] + extend, up[i][j - 1] + double) if j > 1 else s[i][0] + opening
                    s[i][j] = max(s[i - 1][j - 1] + table[ord(x[i - 1]), ord(y[j - 1])], up[i][j], left[i][j], *([0.0] if method == "local" else []))
            got, _ = align._fill(np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8), table, method, gaps)
            assert np.allclose(got, s)


def test_paired_files_and_regions(spark, tmp_path):
    from strandframe.sources import regions

    (tmp_path / "g.txt").write_text("s1\ts2\nA\tB\nX\tA\n")
    (tmp_path / "p.txt").write_text("CHR\tPOS\nc1\t5\nc1\t9\n")
    codes = {"A": 0, "B": 2, "X": -1}
    got = {tuple(r) for r in regions.read_paired(spark, str(tmp_path / "g.txt"), str(tmp_path / "p.txt"), codes=codes).collect()}
    assert got == {(1, "c1", "5", "s1", 0), (1, "c1", "5", "s2", 2), (2, "c1", "9", "s1", -1), (2, "c1", "9", "s2", 0)}
    assert regions.paired_lines(spark, str(tmp_path / "g.txt"), str(tmp_path / "p.txt"), limit=1).first()["geno_line"] == "A\tB"
    (tmp_path / "bad.txt").write_text("s1\ts2\nA\n")
    for path, table in (("bad.txt", codes), ("g.txt", {"A": 0})):
        try:
            regions.read_paired(spark, str(tmp_path / path), str(tmp_path / "p.txt"), codes=table).collect()
        except Exception:
            continue
        raise AssertionError(path)
    cells = spark.createDataFrame([(1, "b", 2), (0, "a", 0), (0, "b", 1), (1, "a", -1)], "snp_idx long, sample string, value int")
    path = regions.save_region(cells, None, str(tmp_path), form="tab")
    assert path.endswith("/n-2-2.nalt.txt.gz") and [r[0] for r in spark.read.text(path).collect()] == ["a\tb", "0\t1", "-1\t2"]
