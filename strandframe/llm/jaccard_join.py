"""Operator 9: n-gram Jaccard self-join by adaptive multi-match prefixes.

Documents with equal shingle sets form a class; only classes are joined. Under one global order of shingles two sets whose
similarity is at least t share at least l shingles among the first n - ceil(t * n) + l of each. Every class chooses its own
l: at least the value at which the cost of a longer prefix meets the gain of fewer candidates, and more where its prefix
holds frequent shingles; a pair must share as many as the smaller of its two values. The order puts frequent shingles last.

Sizes are cut into bands so wide that linked sets lie in one band or in neighbouring ones. A prefix group holds the classes
of one band, and those of the band below, that have one prefix shingle. Classes with too few shingles that others have are
dropped. In a group sizes and a signature of bucket sums rule out most pairs; the rest are joined into clusters, of which
only a spanning forest leaves the task. All links lie inside clusters.

Each text of a cluster then meets the text of its representative once and is turned into the shingles in which the two sets
differ. These differences, far smaller than texts, go to blocks that meet pairwise if the cluster is large. There pairs must
share enough prefix shingles and are then verified, every one: for sets A and B that share a and b shingles with the
representative R and differ from it in D and E, the intersection of A and B is a + b - |R| + |D and E in common|, exactly.
A block leaves one row per class: its number of links, and a star.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components
from .tokens import U, list_array, mixed, shingle_set, signed, small, words

#: Frequent shingles that the order knows; more of them only make the order finer.
HEAVY = 1 << 16
#: A shingle counts as frequent from this many documents on, and from this many in one stretch of a partition.
HEAVY_FROM, LOCAL_FROM, STRETCH = 32, 3, 1 << 20
#: Weight of one more indexed shingle against one more candidate.
INDEX_COST = 0.25
MOST_MATCHES = 64
#: Buckets of a signature, four bits each, and rows of a block of a large prefix group.
BUCKETS, BLOCK, CLUSTER_BLOCK = 128, 512, 512
#: Elements of sets that are counted at once.
MOST_AT_ONCE = 1 << 22
#: Parts in which the prefix shingles are counted and joined one after the other.
PARTS = 4


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity num / den at which two sets link, in whole numbers."""

    k: int = 3
    num: int = 90
    den: int = 100
    #: Sets larger than this carry a wide signature too; by default those whose links may differ in most buckets of the small one.
    wide_from: int | None = None

    def least(self, n):
        """Shingles that a set of n shares with any that links to it, at least."""
        return -(-self.num * n // self.den)

    def matches(self, n):
        """Shared prefix shingles that a set of n asks for at least; grows with n."""
        return np.maximum(1, np.minimum(MOST_MATCHES, np.sqrt((self.den - self.num) / self.den * n / INDEX_COST).astype(np.int64)))

    def differ(self, n, m):
        """Shingles in which two linked sets of n and m differ, at most."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def linked(self, n, m, both):
        return self.den * both >= self.num * (n + m - both)

    def bands(self) -> np.ndarray:
        """Smallest sizes of the bands: each is the first that no set of the size before the last band can link to."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out, np.int64)

    def large(self) -> int:
        return self.wide_from if self.wide_from is not None else BUCKETS * 4 // 5 * (self.den + self.num) // (2 * (self.den - self.num))

    def buckets(self, n: int) -> int:
        """Buckets of a wide signature: about twice as many as linked sets differ in, as a power of two."""
        return 1 << max(1, (self.differ(n, n) * 19 // 8 - 1).bit_length())


def heavy_shingles(docs: DataFrame, text: str, k: int) -> DataFrame:
    """(h, n): shingles that repeat within stretches of partitions, with about how many documents hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL_FROM
            return pa.RecordBatch.from_arrays([pa.array(signed(h[often])), pa.array(n[often])], ["h", "n"])

        for b in small(batches):
            for t in b.column(0).to_pylist():
                held.append(shingle_set(words(t, lower=True)[0], k))
                size += len(held[-1])
                if size >= STRETCH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_FROM)


def class_id(s: np.ndarray) -> int:
    """A hash of a sorted shingle set."""
    sums = np.stack([mixed(s), mixed(s ^ U(0xABCDEF))]).sum(axis=1, dtype=U)
    return int(mixed(sums[:1] ^ mixed(sums[1:] + U(len(s)))).view(np.int64)[0])


def signature(s: np.ndarray, buckets: int = BUCKETS) -> bytes:
    """Sums, modulo 16, of the shingles that fall into each bucket: sets that differ in d shingles differ in d buckets at most."""
    x = mixed(s ^ U(0x5555))
    sums = np.bincount((x % U(buckets)).astype(np.int64), weights=((x >> U(32)) % U(15) + U(1)).astype(float), minlength=buckets).astype(np.int64) % 16
    return (sums[::2] * 16 + sums[1::2]).astype(np.uint8).tobytes()


def wide_signature(s: np.ndarray, rule: Rule) -> bytes | None:
    """For large sets, which differ in every bucket of the small signature, one with more buckets."""
    return signature(s, rule.buckets(len(s))) if len(s) > rule.large() else None


def unpacked(sig: bytes, buckets: int | None = None) -> np.ndarray:
    """The bucket sums, folded to fewer buckets on demand (numbers of buckets are powers of two)."""
    raw = np.frombuffer(sig, np.uint8)
    out = np.stack([raw >> 4, raw & 15], axis=1).ravel()
    return out if buckets is None else out.reshape(-1, buckets).sum(axis=0) & 15


def prefix(s: np.ndarray, heavy: np.ndarray, counts: np.ndarray, rule: Rule) -> tuple[int, np.ndarray]:
    """How many matches the set asks for, and its prefix for that many."""
    n = len(s)
    at = np.minimum(np.searchsorted(heavy, s), max(0, len(heavy) - 1))
    weight = np.where(heavy[at] == s, counts[at], 0) if len(heavy) else np.zeros(n, np.int64)
    order = np.lexsort((s, weight))
    least = rule.least(n)
    want = int(min(least, rule.matches(n)))
    cost = float(np.maximum(1, weight[order[: n - least + want]]).sum())
    # Candidates are at most cost / l: lengthen until another shingle costs as much as it saves.
    want = int(min(least, max(want, min(MOST_MATCHES, (cost / INDEX_COST) ** 0.5 / 2))))
    return want, s[order[: n - least + want]]


def draw(docs: DataFrame, text: str, key: str, rule: Rule, heavy: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(id, th, n, band, c, sig, wide, l, prefix) per row: hash of the text, set size, its band, class and what the join needs of it."""
    bands = rule.bands()
    known = docs.sparkSession.sparkContext.broadcast((heavy, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, c, sig, wide, l, p = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(words(t, lower=True)[0], rule.k)
                want, first = prefix(s, *known.value, rule) if len(s) else (0, s)
                n.append(len(s))
                c.append(class_id(s) if len(s) else None)
                sig.append(signature(s))
                wide.append(wide_signature(s, rule))
                l.append(want)
                p.append(signed(first))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(np.searchsorted(bands, n, "right"), pa.int32()), pa.array(c, pa.int64()), pa.array(sig, pa.binary()), pa.array(wide, pa.binary()), pa.array(l, pa.int32()), list_array(p, pa.int64())], ["id", "th", "n", "band", "c", "sig", "wide", "l", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("th")).mapInArrow(run, f"id {kind}, th long, n long, band int, c long, sig binary, wide binary, l int, prefix array<long>")


def _pairs_of_groups(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs inside blocks, a few hundred thousand at a time."""
    for g in np.unique(sizes):
        if g < 2:
            continue
        i, j = np.triu_indices(int(g), 1)
        at = starts[sizes == g]
        step = max(1, 200_000 // len(i))
        for x in range(0, len(at), step):
            s = at[x : x + step, None]
            u, v = (s + i).ravel(), (s + j).ravel()
            for k in range(0, len(u), 200_000):
                yield u[k : k + 200_000], v[k : k + 200_000]


def smallest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest that links (u, v) connect it to: roots are hooked to smaller ones until no link joins two."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            return top
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]


def stars(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Two rows of numbers, the smallest and each other one that links (u, v) connect to it."""
    top = smallest(n, u, v)
    far = np.flatnonzero(top != np.arange(n))
    return np.stack([top[far], far])


def in_reach(cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Of row pairs those of two classes whose sizes allow a link, which meet in this block alone."""
    n, m = cols["n"][x], cols["n"][y]
    keep = (cols["c"][x] != cols["c"][y]) & (rule.den * np.minimum(n, m) >= rule.num * np.maximum(n, m))
    keep &= (cols["i"][x] == cols["j"][x]) | (cols["blk"][x] != cols["blk"][y])
    return x[keep], y[keep]


def possible(cols: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Of row pairs those that sizes and signatures cannot rule out; pairs of the band below meet in a group of their own."""
    keep = (cols["own"][x] | cols["own"][y]) == 1
    x, y = in_reach(cols, x[keep], y[keep], rule)
    may = rule.differ(cols["n"][x], cols["n"][y])
    d = cols["sig"][x] ^ cols["sig"][y]
    keep = np.count_nonzero(d & 0xF0, axis=1) + np.count_nonzero(d & 0x0F, axis=1) <= may
    x, y, may = x[keep], y[keep], may[keep]
    large = np.flatnonzero((cols["n"][x] > rule.large()) & (cols["n"][y] > rule.large()))
    if len(large):
        keep = np.ones(len(x), bool)
        for k in large.tolist():
            a, b = cols["wide"][x[k]], cols["wide"][y[k]]
            buckets = 2 * min(len(a), len(b))
            keep[k] = np.count_nonzero(unpacked(a, buckets) != unpacked(b, buckets)) <= may[k]
        x, y = x[keep], y[keep]
    return x, y


def in_blocks(batches: Iterator[pa.RecordBatch], names: list[str], others: list[str], rows: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Columns of sorted rows, some thousands at a time, never splitting a block (the first three columns): columns, starts and sizes of blocks."""
    held = None

    def whole(cols: dict):
        a, i, j = (cols[x] for x in names[:3])
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        return cols, new, np.diff(np.r_[new, len(a)])

    for b in batches:
        cols = {x: b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names}
        for x in others:
            if x == "sig":
                cols[x] = np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            elif pa.types.is_list(b.column(x).type):
                flat, ends = b.column(x).flatten().to_numpy(), np.cumsum(b.column(x).value_lengths().to_numpy())
                cols[x] = np.empty(b.num_rows, object)
                for k, part in enumerate(np.split(flat, ends[:-1])):
                    cols[x][k] = part
            else:
                cols[x] = np.array([*b.column(x).to_pylist(), None], object)[:-1]
        held = cols if held is None else {x: np.concatenate([held[x], cols[x]]) for x in cols}
        if len(held["c"]) >= rows:
            # The last block may go on in the next batch.
            cut = whole(held)[1][-1]
            if cut:
                yield whole({x: v[:cut] for x, v in held.items()})
                held = {x: v[cut:] for x, v in held.items()}
    if held is not None and len(held["c"]):
        yield whole(held)


def similar(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): per run of prefix groups, each class with the smallest that pairs which cannot be ruled out connect it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts, sizes in in_blocks(batches, ["key", "i", "j", "blk", "c", "n", "own"], ["sig", "wide"], 20_000):
            ids, at = np.unique(cols["c"], return_inverse=True)
            met = []
            for x, y in _pairs_of_groups(starts, sizes):
                x, y = possible(cols, x, y, rule)
                met.append(stars(len(ids), at[x], at[y]))
            # Stars around the smallest class: those of different tasks coincide, where trees of links would add up.
            top, far = stars(len(ids), *np.concatenate([np.zeros((2, 0), np.int64), *met], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[top]), pa.array(ids[far])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def in_common(sets: np.ndarray | dict[int, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements the sets of rows x and y have in common, pair by pair; no set is empty."""
    if not len(x):
        return np.zeros(0, np.int64)
    rows = np.unique(np.r_[x, y])
    parts = [sets[r] for r in rows.tolist()]
    sizes = np.array([len(p) for p in parts])
    if sizes.sum() > MOST_AT_ONCE and len(x) > 1:
        half = len(x) // 2
        return np.r_[in_common(sets, x[:half], y[:half]), in_common(sets, x[half:], y[half:])]
    ids = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int32)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    seen = np.zeros(ids.max() + 1, bool)
    u, v = np.searchsorted(rows, x), np.searchsorted(rows, y)
    out, order = np.empty(len(x), np.int64), np.argsort(u, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(u[order])) + 1):
        seen[parts[u[at[0]]]] = True
        ends = np.cumsum(sizes[v[at]])
        for few in np.split(at, np.flatnonzero(np.diff(ends // MOST_AT_ONCE)) + 1):
            held = seen[np.concatenate([parts[k] for k in v[few].tolist()])]
            out[few] = np.add.reduceat(held, np.r_[0, np.cumsum(sizes[v[few]])[:-1]], dtype=np.int64)
        seen[parts[u[at[0]]]] = False
    return out


def differences(texts: DataFrame, rule: Rule) -> DataFrame:
    """(c, label, s, r, d) of rows (c, label, text, other): shingles shared with the representative's text, that one's number of shingles, and those in which they differ.

    Rows whose text is not of class c are left out: where a key has several rows, the one of the class is found by hashing
    again. d starts with a zero that stands for no shingle, so that it is never empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, r = None, np.zeros(0, U)
        for b in small(batches, 256):
            at, s, n, d = [], [], [], []
            for i, (c, t, other) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                own = shingle_set(words(t, lower=True)[0], rule.k)
                if not len(own) or class_id(own) != c:
                    continue
                if other != last:
                    last, r = other, shingle_set(words(other, lower=True)[0], rule.k)
                apart = np.setxor1d(own, r, assume_unique=True)
                at.append(i)
                s.append((len(own) + len(r) - len(apart)) // 2)
                n.append(len(r))
                d.append(np.r_[0, signed(apart)])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(s, pa.int64()), pa.array(n, pa.int64()), list_array(d, pa.int64())], ["c", "label", "s", "r", "d"])

    return texts.select("c", "label", "text", "other").mapInArrow(run, "c long, label long, s long, r long, d array<long>")


def linked(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, n) per block and class b that has links in it: how many, and the smallest class they connect it to in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts, sizes in in_blocks(batches, ["label", "i", "j", "blk", "c", "n", "l", "s", "r"], ["prefix", "d"], 1024):
            ids, at = np.unique(cols["c"], return_inverse=True)
            degree, met = np.zeros(len(at), np.int64), []
            for x, y in _pairs_of_groups(starts, sizes):
                x, y = in_reach(cols, x, y, rule)
                keep = in_common(cols["prefix"], x, y) >= np.minimum(cols["l"][x], cols["l"][y])
                x, y = x[keep], y[keep]
                both = cols["s"][x] + cols["s"][y] - cols["r"][x] + in_common(cols["d"], x, y) - 1
                keep = rule.linked(cols["n"][x], cols["n"][y], both)
                x, y = x[keep], y[keep]
                degree += np.bincount(np.r_[x, y], minlength=len(degree))
                met.append(stars(len(ids), at[x], at[y]))
            u, v = np.concatenate([np.zeros((2, 0), np.int64), *met], axis=1)
            top, has = smallest(len(ids), u, v), np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(ids[top[at[has]]]), pa.array(cols["c"][has]), pa.array(degree[has])], ["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long")


def paired(rows: DataFrame, by: str, size: str, block: int) -> DataFrame:
    """Deals the rows of each group to blocks that meet pairwise: adds blk, i and j, sorted and partitioned by group, i and j."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    laid = rows.withColumn("blk", F.pmod(F.xxhash64("c", by), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    laid = laid.withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).drop("o", size)
    return laid.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def prefix_groups(scratch: Scratch, classes: DataFrame, rule: Rule) -> DataFrame:
    """(c, key, own, group): of classes (c, n, band, prefix) the prefix groups in which they may meet a partner, with the size of the group.

    A group is a prefix shingle and a band; own is 1 for classes of that band and 0 for those of the band below, which meet
    one another elsewhere. Partners share as many groups as the smaller of their demands, so of a class only sides (own or
    not) with that many groups stay. Few shingles have company, but all must be dealt out to find them; these are taken in
    PARTS, so that the shuffle files of one part alone lie on disk at a time.
    """
    key = lambda band, own: F.struct(F.xxhash64("tok", band).alias("key"), F.lit(own).cast("byte").alias("own"))
    each = classes.select("c", "n", "band", F.explode("prefix").alias("tok"))
    shared = []
    for part in range(PARTS):
        some = each.filter(F.pmod("tok", F.lit(PARTS)) == part).select("c", "n", F.inline(F.array(key(F.col("band"), 1), key(F.col("band") + 1, 0))))
        shared.append(_in_company(scratch, some))
    every = reduce(DataFrame.unionByName, shared)
    # One less than the partner's least demand, so that rounding cannot tell the two sides apart.
    partner = F.ceil(F.col("n") * rule.num / rule.den)
    least = F.least(F.lit(MOST_MATCHES), F.floor(F.sqrt(partner * ((rule.den - rule.num) / rule.den / INDEX_COST))), F.ceil(partner * rule.num / rule.den)) - 1
    able = every.groupBy("c", "n", "own").agg(F.count("*").alias("m")).filter(F.col("m") >= least).select("c", "own")
    left = scratch.put(every.drop("group").join(able.hint("merge"), ["c", "own"]))
    scratch.drop(*shared)
    out = _in_company(scratch, left)
    scratch.drop(left)
    return out


def _in_company(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Rows (key, own, ..) of groups with at least two rows, one of them own; adds group, the number of rows."""
    often = scratch.put(rows.groupBy("key").agg(F.count("*").alias("group"), F.max("own").alias("any")).filter("group > 1 AND any = 1").select("key", "group"))
    scratch.sweep()
    out = scratch.put(rows.join(often.hint("merge"), "key"))
    scratch.drop(often)
    return out


def join_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", rule: Rule = Rule()) -> DataFrame:
    """(key, text_hash, n_shingles, component_id, class_id, n_links): xxhash64 of the text, set size, smallest key reachable over links, class of equal sets, number of other classes that link to it.

    Texts are lower-cased (A-Z). A null text, or one without words, has no shingles and links with nothing, not even its
    like; its class is null. A text of fewer than k words is one shingle. Rows that repeat share a class. A null key takes
    part, but names a component only if nothing else does. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    known = heavy_shingles(docs, text, rule.k).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    heavy = known.column("h").to_numpy().view(U)
    by = np.argsort(heavy)
    drawn = scratch.put(draw(docs, text, key, rule, heavy[by], known.column("n").to_numpy()[by]))
    classes = drawn.filter("n > 0").groupBy("c", "n", "band").agg(F.min("id").alias("first_id"), F.first("sig").alias("sig"), F.first("wide").alias("wide"), F.first("l").alias("l"), F.first("prefix").alias("prefix"))
    classes = scratch.put(classes)
    of_rows = scratch.put(drawn.select("id", "th", "n", F.col("c").alias("of")))
    scratch.drop(drawn)

    groups = prefix_groups(scratch, classes, rule)
    signed_ = groups.join(classes.select("c", "sig", "wide").hint("merge"), "c")
    edges = scratch.put(similar(paired(signed_, "key", "group", BLOCK), rule))
    scratch.drop(groups)
    found = components(scratch, edges)
    clusters = scratch.put(found.withColumnRenamed("node", "c"))
    scratch.drop(found, edges)
    # Texts meet that of their cluster's representative, the class that names it; an equal text of another row does as well.
    members = clusters.join(classes.select("c", F.struct(F.col("first_id").alias("v")).alias("k")).hint("merge"), "c")
    texts = docs.select(F.struct(F.col(key).alias("v")).alias("k"), F.col(text).alias("text")).join(members.hint("merge"), "k").select("c", "label", "text")
    texts = scratch.put(texts)
    scratch.sweep()
    others = scratch.put(_of_class(texts.filter("c = label").select("c", "text"), rule.k).groupBy("c").agg(F.min("text").alias("other")).withColumnRenamed("c", "of"))
    apart = differences(texts.join(others.hint("merge"), F.col("label") == F.col("of")), rule)
    # Rows of one key that repeat count once.
    apart = scratch.put(apart.groupBy("c", "label").agg(F.first("s").alias("s"), F.first("r").alias("r"), F.first("d").alias("d")))
    scratch.drop(texts, others)
    sizes = scratch.put(clusters.groupBy("label").agg(F.count("*").alias("size")))
    laid = apart.join(classes.select("c", "n", "l", "prefix").hint("merge"), "c").join(sizes, "label")
    links = scratch.put(linked(paired(laid, "label", "size", CLUSTER_BLOCK), rule))
    scratch.drop(apart)
    labels = components(scratch, links)
    degree = links.groupBy(F.col("b").alias("of")).agg(F.sum("n").alias("n_links"))

    names = classes.select("c", "first_id").join(labels, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c"))
    named = names.groupBy("label").agg(F.min("first_id").alias("component_id"))
    per_class = scratch.put(names.join(named, "label").join(degree, F.col("c") == F.col("of"), "left").select("c", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    scratch.drop(classes, clusters, labels, links)
    out = of_rows.join(per_class, F.col("of") == F.col("c"), "left")
    return out.select(F.col("id").alias(key), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("of").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _of_class(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (c, text) those whose text has the class c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            same = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(words(t, lower=True)[0], k)
                same.append(len(s) > 0 and class_id(s) == c)
            yield b.filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")




#: Whole sets of words in place of hashes, all links, and their closure; for tables that one machine holds.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
docs AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS c, s FROM sets),
classes AS (SELECT c, min(n) AS n, min(doc_id) AS first_id, any_value(s) AS s FROM docs WHERE n > 0 GROUP BY c),
each AS (SELECT c, n, unnest(s) AS g FROM classes),
met AS (SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
links AS (SELECT x, y FROM met WHERE 100 * k >= 90 * (nx + ny - k) UNION ALL SELECT y, x FROM met WHERE 100 * k >= 90 * (nx + ny - k)),
reach AS (SELECT c, c AS r FROM classes UNION SELECT reach.c, links.y FROM reach JOIN links ON links.x = reach.r),
named AS (SELECT reach.c, min(first_id) AS component_id FROM reach JOIN classes ON classes.c = reach.r GROUP BY reach.c),
degree AS (SELECT x AS c, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM docs LEFT JOIN named USING (c) LEFT JOIN degree USING (c)
"""
