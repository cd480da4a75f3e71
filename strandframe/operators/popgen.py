"""Distances, allele frequencies, FST, linkage and principal components over long genotype frames (sample_id, pos, nalt)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch
from .blocks import COLUMNS, counts, each_way, matrix, meet, pack, size_for
from .sequence import columns_of

BLOCK = 256
#: Samples of a part in sums over samples, and those sums.
SAMPLES = 8192
SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def packed(diff: Column, n: Column) -> Column:
    """One integer for (diff, n): n * n + diff, decodable while diff <= 2 n."""
    return n * n + diff


def unpacked(code: Column) -> dict[str, Column]:
    root = F.floor(F.sqrt(code.cast("double"))).cast("long")
    n = F.when(root * root > code, root - 1).when((root + 1) * (root + 1) <= code, root + 1).otherwise(root)
    return {"diff": code - n * n, "n": n}


def _rows(cells: DataFrame, *, id: str, col: str, value: str, missing: list | None = None) -> DataFrame:
    """(id, c, v): the columns of each row, in order, and their values. Rows of which all is missing have empty arrays."""
    v = F.col(value) if dict(cells.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else F.col(value).cast("string")
    cell = F.struct(F.col(col).cast("long").alias("c"), v.alias("v"))
    cell = cell if missing is None else F.when(~F.col(value).isin(*missing), cell)
    row = cells.groupBy(F.col(id).alias("id")).agg(F.array_sort(F.collect_list(cell)).alias("row"))
    return row.select("id", F.col("row.c").alias("c"), F.col("row.v").alias("v"))


def _packed(scratch: Scratch, rows: DataFrame, key: str, body, *, size: int | None = None) -> tuple[DataFrame, int]:
    """Rows with arrays c and v in packed blocks (part, b, body), and how many these are."""
    rows = scratch.put(rows)
    n, width = rows.agg(F.count("*")).first()[0], rows.select(F.explode("c").alias("c")).agg(F.approx_count_distinct("c")).first()[0]
    blocks = max(1, -(-n // (size or size_for(n, width))))
    laid = rows.withColumns({"part": F.lit(0).cast("long"), "b": F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")})
    return scratch.put(pack(laid, ["part", "b"], body)), blocks


def _all(blocks: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))


def pair_counts(cells: DataFrame, *, id: str, col: str, value: str, missing: list | None = None, size: int | None = None) -> DataFrame:
    """(i, j, diff, n) for all i < j: columns that differ, and columns both have.

    Rows are cut into blocks that meet pairwise; inside, counts are products of 0/1 matrices: n = V V', same = sum over values
    of 1 1'. A block is packed once, as a matrix of small numbers, and what leaves a pair of blocks leaves it in portions, so
    memory is bounded whatever the number of rows; nothing is joined cell by cell.
    """
    packed, blocks = _packed(Scratch(cells.sparkSession, "pairs"), _rows(cells, id=id, col=col, value=value, missing=missing), "id", lambda t: matrix(t) | {"id": t.column("id").to_numpy()}, size=size)

    def count(a: dict, b: dict | None) -> Iterator[dict]:
        n, same = counts(a, b)
        for i, j, p, q in each_way(a, b):
            both = n[i, j]
            yield {"i": p, "j": q, "diff": (both - same[i, j]).astype(np.int32), "n": both.astype(np.int32)}

    kind = cells.schema[id].dataType.simpleString()
    got = meet(packed, _all(blocks), count, f"i {kind}, j {kind}, diff int, n int", pairs=blocks * (blocks + 1) // 2)
    return got.select("i", "j", F.col("diff").cast("long").alias("diff"), F.col("n").cast("long").alias("n"))


def share(diff: Column, n: Column, digits: int | None = None) -> Column:
    """diff / n, null where n is 0; with digits rounded half up, in whole numbers."""
    if digits is None:
        return F.try_divide(diff, n)
    whole = F.call_function("div", 2 * diff * 10**digits + n, 2 * F.greatest(n, F.lit(1)))
    return F.when(n > 0, whole / float(10**digits))


def sequence_distance(df: DataFrame, *, skip_gaps: bool = False, digits: int | None = None) -> DataFrame:
    """(i, j, d): share of differing columns; with skip_gaps of those in which neither has a gap (null if there are none)."""
    pairs = pair_counts(columns_of(df), id="ord", col="col", value="base", missing=["-"] if skip_gaps else None)
    return pairs.select("i", "j", share(F.col("diff"), F.col("n"), digits).alias("d"))


def genotype_distance(geno: DataFrame, *, skip_missing: bool = True, digits: int | None = None) -> DataFrame:
    """(i, j, diff, n, d) over genotype codes; missing ones (-1) are skipped. d is 0 where nothing overlaps."""
    pairs = pair_counts(geno, id="sample_id", col="pos", value="nalt", missing=[-1] if skip_missing else None)
    return pairs.withColumn("d", F.coalesce(share(F.col("diff"), F.col("n"), digits), F.lit(0.0)))


def dxy(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """(g1, g2, dxy) for all pairs of groups, both ways round: mean distance of their members; inside a group each sample also meets itself."""
    a = groups.select(F.col("sample_id").alias("i"), F.col("grp").alias("g1"))
    b = groups.select(F.col("sample_id").alias("j"), F.col("grp").alias("g2"))
    d = distances.join(a, "i").join(b, "j")
    both = d.select("g1", "g2", "d").unionByName(d.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "d"))
    own = groups.select(F.col("grp").alias("g1"), F.col("grp").alias("g2"), F.lit(0.0).alias("d"))
    return both.unionByName(own).groupBy("g1", "g2").agg(F.avg("d").alias("dxy"))


def genotype_dxy(geno: DataFrame, groups: DataFrame, *, size: int | None = None) -> DataFrame:
    """dxy over the genotype distances of samples that share a called position, summed where they arise: no pair of samples leaves its block.

    groups has one row per sample. Samples of a group with equal genotypes are one row with its number, so copies cost no
    pairs; between different rows all pairs are counted. Groups of which no two samples share a position are left out.
    """
    rows = _rows(geno, id="sample_id", col="pos", value="nalt", missing=[-1]).withColumnRenamed("id", "sample_id").join(groups.select("sample_id", "grp"), "sample_id")
    alike = rows.filter(F.size("c") > 0).groupBy("grp", "c", "v").agg(F.count("*").alias("k"))

    def body(t: pa.Table) -> dict:
        coded = t.column("grp").combine_chunks().dictionary_encode()
        own = np.zeros((t.num_rows, len(coded.dictionary)))
        own[np.arange(t.num_rows), coded.indices.to_numpy()] = t.column("k").to_numpy()
        return matrix(t) | {"grp": coded.dictionary.to_numpy(zero_copy_only=False), "own": own}

    packed, blocks = _packed(Scratch(geno.sparkSession, "dxy"), alike.withColumn("alike", F.xxhash64("grp", "c", "v")), "alike", body, size=size)

    def count(a: dict, b: dict | None) -> Iterator[dict]:
        n, same = counts(a, b)
        met = n > 0
        d = np.divide(n - same, n, out=np.zeros(n.shape), where=met, dtype=np.float64)
        o = a if b is None else b
        s, w = a["own"].T @ (d @ o["own"]), a["own"].T @ (met @ o["own"])
        if b is None:
            w -= np.diag(a["own"].sum(0))  # a sample with itself
        g1, g2 = (x.ravel() for x in np.meshgrid(a["grp"], o["grp"], indexing="ij"))
        yield {"g1": g1, "g2": g2, "s": s.ravel(), "w": w.ravel()}
        if b is not None:
            yield {"g1": g2, "g2": g1, "s": s.ravel(), "w": w.ravel()}

    kind = groups.schema["grp"].dataType.simpleString()
    got = meet(packed, _all(blocks), count, f"g1 {kind}, g2 {kind}, s double, w double", pairs=blocks * (blocks + 1) // 2)
    own = groups.select(F.col("grp").alias("g1"), F.col("grp").alias("g2"), F.lit(0.0).alias("s"), F.lit(1.0).alias("w"))
    return got.unionByName(own).groupBy("g1", "g2").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).filter("w > 0").select("g1", "g2", (F.col("s") / F.col("w")).alias("dxy"))


def da(between: DataFrame) -> DataFrame:
    """(g1, g2, da): dxy less the mean of both inner distances."""
    between = Scratch(between.sparkSession, "da").put(between)  # read three times
    own = between.filter("g1 = g2")
    x = own.select("g1", F.col("dxy").alias("dx"))
    y = own.select("g2", F.col("dxy").alias("dy"))
    return between.join(x, "g1").join(y, "g2").select("g1", "g2", (F.col("dxy") - (F.col("dx") + F.col("dy")) / 2).alias("da"))


def population_counts(geno: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, pos, n0, n1): reference and alternate alleles of called genotypes."""
    g = geno.filter("nalt >= 0").join(groups, "sample_id")
    return g.groupBy("grp", "pos").agg(F.sum(2 - F.col("nalt")).alias("n0"), F.sum("nalt").alias("n1"))


def hudson_fst(counts: DataFrame, a: str | list[str], b: str | list[str]) -> DataFrame:
    """(pos, fst) of two sets of groups by Hudson's estimator; -1 where nothing varies between them."""
    sets = [[x] if isinstance(x, str) else x for x in (a, b)]
    side = lambda i, c: F.sum(F.when(F.col("grp").isin(*sets[i]), F.col(c)).otherwise(0))
    p = counts.groupBy("pos").agg(*[side(i, c).alias(f"{c}_{i}") for i in (0, 1) for c in ("n0", "n1")])
    return p.select("pos", fst_of(*[F.col(f"{c}_{i}") for i in (0, 1) for c in ("n0", "n1")]).alias("fst"))


def fst_of(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    within = F.lit(0.0)
    for x, y in ((a0, a1), (b0, b1)):
        n = x + y
        within = within + F.coalesce(F.try_divide(2.0 * x * y, n * (n - 1)), F.lit(0.0)) / 2
    na, nb = a0 + a1, b0 + b1
    between = 1 - F.coalesce(F.try_divide(a0 * b0 + a1 * b1, na * nb), F.lit(1.0))
    return F.when(between == 0, -1.0).otherwise((between - within) / between)


def ld(geno: DataFrame, *, max_distance: int | None = None, group: str | None = None, size: int = BLOCK, samples: int = SAMPLES) -> DataFrame:
    """(p, q, r2) of positions p < q (of one group, if given): squared correlation of dosages over samples called at both; null where one does not vary.

    Positions are cut into blocks that meet pairwise, or, with max_distance, into bins as wide as it that meet their
    neighbours, and samples into parts; the sums over the samples of a part are products of matrices, and the parts' sums are
    added up. No two cells are joined, and memory is bounded whatever the number of samples or positions.
    """
    scratch = Scratch(geno.sparkSession, "ld")
    g = scratch.put(geno.filter("nalt >= 0").select((F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col("pos").cast("long").alias("pos"), F.col("sample_id").cast("long").alias("s"), F.col("nalt").cast("double").alias("x")))
    bin = F.floor(F.col("pos") / max(1, max_distance)) if max_distance is not None else F.lit(0).cast("long")
    ids = g.select("s").distinct().count()
    n = g.select("g", "pos").distinct().groupBy("g", bin.alias("bin")).count().agg(F.max("count")).first()[0] or 0
    parts, blocks = max(1, -(-ids // samples)), max(1, -(-n // size))
    laid = g.withColumns({"part": F.xxhash64("g", F.pmod(F.xxhash64("s"), F.lit(parts))), "b": bin * blocks + F.pmod(F.xxhash64("pos"), F.lit(blocks))})

    def body(t: pa.Table) -> dict:
        pos, k = np.unique(t.column("pos").to_numpy(), return_inverse=True)
        who, at = np.unique(t.column("s").to_numpy(), return_inverse=True)
        x = np.full((len(pos), len(who)), np.nan)
        x[k, at] = t.column("x").to_numpy()
        return {"g": t.column("g")[0].as_py(), "id": pos, "who": who, "x": x.astype(np.float32) if (x.astype(np.float32) == x)[~np.isnan(x)].all() else x}

    def count(a: dict, b: dict | None) -> Iterator[dict]:
        o = a if b is None else b
        if a["g"] != o["g"]:
            return
        _, ia, ib = np.intersect1d(a["who"], o["who"], assume_unique=True, return_indices=True)
        total = np.zeros((6, len(a["id"]), len(o["id"])))
        for lo in range(0, len(ia), COLUMNS):
            (x, m), (y, w) = ((np.nan_to_num(v), (~np.isnan(v)).astype(np.float64)) for v in (a["x"][:, ia[lo : lo + COLUMNS]].astype(np.float64), o["x"][:, ib[lo : lo + COLUMNS]].astype(np.float64)))
            total += [u @ v.T for u, v in ((m, w), (x, w), (m, y), (x, y), (x * x, w), (m, y * y))]
        keep = lambda i, j: (total[0, i, j] > 0) & ((max_distance is None) | (np.abs(a["id"][i] - o["id"][j]) <= (max_distance or 0)))
        for i, j, p, q in each_way(a, b, keep):
            turned = a["id"][i] > o["id"][j]
            s = dict(zip(SUMS, total[:, i, j], strict=True))
            for u, v in (("sx", "sy"), ("sxx", "syy")):
                s[u], s[v] = np.where(turned, s[v], s[u]), np.where(turned, s[u], s[v])
            yield {"g": np.full(len(p), a["g"], object), "p": p, "q": q, **s}

    packed = scratch.put(pack(laid, ["part", "b"], body))
    near = lambda k: (F.floor(F.col("b") / blocks) + k) * blocks
    others = F.sequence(near(0), near(1) - 1) if max_distance is None else F.sequence(near(-1), near(2) - 1)
    met = meet(packed, others, count, "g string, p long, q long, " + ", ".join(f"{c} double" for c in SUMS), pairs=packed.count() * (blocks + 1) // 2)
    t = met.groupBy("g", "p", "q").agg(*[F.sum(c).alias(c) for c in SUMS])
    own = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    both = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    return t.select("p", "q", F.try_divide(both * both, own).alias("r2"))


def prune(geno: DataFrame, scores: DataFrame, *, r2: float = 0.5, group: str = "chrom", max_distance: int | None = None) -> DataFrame:
    """(group, pos) kept by greedy pruning: best score first (ties by position), dropping what correlates with a kept one at r2 or more.

    What greedy pruning keeps is found in rounds over the pairs that correlate: a position stays once no better neighbour is
    undecided or kept, and its neighbours go. All chromosomes and all parts of them move on at once; rounds are as many as
    the longest chain of neighbours of falling score, and the loop ends when none is undecided.
    """
    scratch = Scratch(geno.sparkSession, "prune")
    nodes = geno.filter("nalt >= 0").select("pos").distinct().join(scores.select("pos", "score", group), "pos")
    nodes = scratch.put(nodes)
    near = ld(geno.join(scores.select("pos", group), "pos"), group=group, max_distance=max_distance).filter(F.col("r2") >= r2)
    both = near.select("p", "q").unionByName(near.select(F.col("q").alias("p"), F.col("p").alias("q")))
    rank = lambda n, x: nodes.select(F.col("pos").alias(n), F.struct(-F.col("score"), F.col("pos")).alias(x))
    edges = scratch.put(both.join(rank("p", "rp"), "p").join(rank("q", "rq"), "q").select("p", "q", (F.col("rq") < F.col("rp")).alias("better")))
    left, kept = nodes.select("pos"), []
    while left.limit(1).count():
        blocked = edges.filter("better").select(F.col("p").alias("pos")).distinct()
        stay = scratch.put(left.join(blocked, "pos", "left_anti"))
        gone = edges.join(stay.select(F.col("pos").alias("q")), "q", "left_semi").select(F.col("p").alias("pos")).distinct()
        left = scratch.put(left.join(stay, "pos", "left_anti").join(gone, "pos", "left_anti"))
        edges = scratch.put(edges.join(left.select(F.col("pos").alias("p")), "p", "left_semi").join(left.select(F.col("pos").alias("q")), "q", "left_semi"))
        kept.append(stay)
    out = nodes.select(group, "pos")
    return out.join(functools.reduce(DataFrame.unionByName, kept), "pos", "left_semi") if kept else out


def pca(df: DataFrame, column: str, k: int, *, scale: bool = False) -> tuple[DataFrame, list[float]]:
    """Adds pc (array of k scores) of centred (and scaled) vectors, and returns the shares of variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("__v", array_to_vector(F.col(column)))
    scaled = StandardScaler(withMean=True, withStd=scale, inputCol="__v", outputCol="__s").fit(v).transform(v)
    model = PCA(k=k, inputCol="__s", outputCol="__p").fit(scaled)
    return model.transform(scaled).withColumn("pc", vector_to_array("__p")).drop("__v", "__s", "__p"), list(model.explainedVariance)


def jitter(df: DataFrame, columns: list[str], *, key: str, scale: float = 0.01, seed: int = 1) -> DataFrame:
    """Adds Gaussian noise, scaled by each column's range, from a seeded hash of the key: reruns give the same, whatever the partitions."""
    spread = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()

    def even(c: str, k: int) -> Column:
        return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(c), key)), 8 * k + 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32

    normal = lambda c: F.sqrt(-2 * F.ln(even(c, 0))) * F.cos(2 * math.pi * even(c, 1))
    return df.withColumns({c: F.col(c) + normal(c) * (scale * (spread[c] or 0)) for c in columns})


def patristic(tree: DataFrame, *, size: int | None = None) -> DataFrame:
    """(i, j, d) of the leaves of a tree (leaf, ancestor, dist): the shortest way over a common ancestor. Leaves are cut into blocks that meet pairwise."""
    cell = F.struct(F.xxhash64(F.col("ancestor").cast("string")).alias("c"), F.col("dist").cast("double").alias("v"))
    row = tree.groupBy(F.col("leaf").alias("id")).agg(F.collect_list(cell).alias("row")).select("id", F.col("row.c").alias("c"), F.col("row.v").alias("v"))

    def body(t: pa.Table) -> dict:
        c, v = (t.column(x).combine_chunks() for x in "cv")
        k, far = pc.list_parent_indices(c).to_numpy(), pc.list_flatten(v).to_numpy()
        over, at = np.unique(pc.list_flatten(c).to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        cut = np.searchsorted(at[order], np.arange(1, len(over)))
        return {"id": t.column("id").to_numpy(), "over": over, "leaves": np.split(k[order], cut), "far": np.split(far[order], cut)}

    def count(a: dict, b: dict | None) -> Iterator[dict]:
        o = a if b is None else b
        d = np.full((len(a["id"]), len(o["id"])), np.inf)
        for x, y in zip(*np.intersect1d(a["over"], o["over"], assume_unique=True, return_indices=True)[1:], strict=True):
            box = np.ix_(a["leaves"][x], o["leaves"][y])
            d[box] = np.minimum(d[box], a["far"][x][:, None] + o["far"][y][None, :])
        met = None if np.isfinite(d).all() else lambda i, j: np.isfinite(d[i, j])
        for i, j, p, q in each_way(a, b, met):
            yield {"i": p, "j": q, "d": d[i, j]}

    packed, blocks = _packed(Scratch(tree.sparkSession, "patristic"), row, "id", body, size=size)
    kind = tree.schema["leaf"].dataType.simpleString()
    return meet(packed, _all(blocks), count, f"i {kind}, j {kind}, d double", pairs=blocks * (blocks + 1) // 2)


def nearest(tree: DataFrame, k: int) -> DataFrame:
    """(i, j, d): the k leaves nearest to each leaf of a tree (leaf, ancestor, dist), ties by leaf, in time that follows the leaves.

    Of the leaves under an ancestor only the first k + 1 by distance and name can be among the k nearest over it: whatever
    comes after them is at least as far from every leaf as k others, and after these by name. So each leaf meets those
    few of each of its ancestors, and the true distance of a near one is the least over its ancestors.
    """
    own = tree.groupBy("leaf", "ancestor").agg(F.min(F.col("dist").cast("double")).alias("dist"))
    first = Window.partitionBy("ancestor").orderBy("dist", "leaf")
    near = own.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("ancestor", F.col("leaf").alias("j"), F.col("dist").alias("y"))
    near = near.groupBy("ancestor").agg(F.collect_list(F.struct("j", "y")).alias("near"))
    met = own.join(near, "ancestor").select(F.col("leaf").alias("i"), "dist", F.explode("near").alias("x")).filter("i <> x.j")
    ways = met.groupBy("i", F.col("x.j").alias("j")).agg(F.min(F.col("dist") + F.col("x.y")).alias("d"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, k)
    return ways.groupBy("i").agg(best.alias("x")).select("i", F.explode("x").alias("x")).select("i", "x.j", "x.d")
