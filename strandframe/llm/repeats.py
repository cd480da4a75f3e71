"""Operator 5: removal of repeated passages, located by Aho-Corasick automata.

A window is WINDOW consecutive words of one document; a word goes if some window over it occurs, as a sequence of words, at
another place too. Three steps find all such windows without bringing every window of the corpus together:

1. Winnowing. Of the GRAM-word grams of every window the one with the smallest hash is its anchor. Equal windows have equal
   anchors, so only anchors that occur at two places matter; they are counted first.
2. A stretch is a run of windows with one anchor, its body their words. Bodies with equal bytes are counted. A body that is
   the only one of its anchor and occurs twice is a passage. Where bodies share an anchor but differ (at the edges of a
   repeated passage), their windows are counted, and of each that occurs twice one place is kept, in the body that stands
   for all. Windows that follow one another there, and do so wherever they occur, make up a passage.
3. The passages are compiled into Aho-Corasick automata, sharded by anchor, and the bodies of all documents are streamed
   through the automaton of their shard, which finds every occurrence byte for byte; the counts above know of one place for
   each passage, all others come from the automata. A passage found once alone was a chance equality of hashes and is
   dropped. An anchor with many bodies is dealt on by the words beside it, and by salt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, table
from .tokens import U, grams, list_array, signed, small, words

WINDOW = 35
BLANKS = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
MANY = re.compile(rb"  +")
#: Words of an anchor; a window has WINDOW - GRAM + 1 of these to choose from.
GRAM = 8
#: Bytes of passages and bodies that one automaton is given at once, and bodies of one anchor from which it is dealt on.
AUTOMATON_BYTES, SHARD_ROWS = 1 << 19, 2048
#: Modulus of the sums that tell whether two windows always follow one another.
M = 1 << 31


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of the word hashes, where its anchor starts: the smallest gram hash, the last of equal ones."""
    g = grams(h, gram)
    span = window - gram + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)[:, ::-1]
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 14):
        out[at : at + (1 << 14)] = span - 1 - view[at : at + (1 << 14)].argmin(axis=1)
    return out + np.arange(n)


def stretches(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash, whether the anchor stands there more than once) of the runs of windows with one anchor.

    In repetitive text a run can be long; it is cut into pieces no longer than a run of one anchor can be.
    """
    a = anchors(h, window, gram)
    if not len(a):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(0, bool)
    g = grams(h, gram)[a]
    runs = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    at = np.arange(len(g))
    new = np.flatnonzero((at - np.repeat(runs, np.diff(np.r_[runs, len(g)]))) % (window - gram + 1) == 0)
    ends = np.r_[new[1:], len(g)]
    return new, ends - new, g[new], a[ends - 1] != a[new]


def spaced(raw: bytes) -> bytes:
    """The words of UTF-8 bytes with one blank between them."""
    out = raw.translate(BLANKS)
    return MANY.sub(b" ", out) if b"  " in out else out


def joined(raw: bytes, s: np.ndarray, e: np.ndarray, first: int, n: int) -> str:
    """n words from the first one, one blank before and after each."""
    return f" {spaced(raw[s[first] : e[first + n - 1]]).decode('utf-8', 'surrogatepass')} "


def recurring_anchors(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """(anchor) that stands at more than one place; summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            got = [stretches(words(t)[0], window, gram)[2:] for t in b.column(0).to_pylist()]
            a, at = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
            n = np.bincount(at, weights=1 + np.concatenate([x for _, x in got]), minlength=len(a)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(n)], ["anchor", "n"])

    return docs.select(text).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def pieces(docs: DataFrame, recurring: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, th, anchor, first, multi, body) of the stretches whose anchors recur, by shuffled joins for any number of anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            got = [signed(np.unique(stretches(words(t)[0], window, gram)[2])) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_array(got, pa.int64())], ["doc", "th", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            yield from _pieces(b, window, gram)

    have = docs.select("doc", "th", "text").mapInArrow(find, "doc long, th long, anchors array<long>").select("doc", "th", F.explode("anchors").alias("anchor"))
    of = have.join(recurring.hint("merge"), "anchor").groupBy("doc", "th").agg(F.collect_set("anchor").alias("known"))
    return docs.select("doc", "th", "text").join(of.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "known").mapInArrow(run, "doc long, th long, anchor long, first long, multi boolean, body string")


def _pieces(b: pa.RecordBatch, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["doc", "th", "anchor", "first", "multi", "body"]
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        at, *cols = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    for i, (t, known) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
        h, s, e, raw = words(t)
        first, n, a, multi = stretches(h, window, gram)
        for j in np.flatnonzero(np.isin(signed(a), np.array(known, np.int64))):
            rows.append((i, int(signed(a[j : j + 1])[0]), int(first[j]), bool(multi[j]), joined(raw, s, e, first[j], n[j] + window - 1)))
            held += len(rows[-1][-1])
            if held >= 1 << 24:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def windows_of(bodies: DataFrame, window: int) -> DataFrame:
    """(anchor, bid, at, wh, copies): every window of every body, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            # One pass over all bodies: each has a blank before and after every word, and windows that run into the next body are left out.
            bodies = b.column(3).to_pylist()
            n = np.array([t.count(" ") - 1 for t in bodies])
            g = signed(grams(words("".join(bodies))[0], window))
            got = [g[at : at + k - window + 1] for at, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), list_array(got, pa.int64())], ["anchor", "bid", "copies", "whs"])

    out = bodies.select("anchor", "bid", "copies", "body").mapInArrow(run, "anchor long, bid long, copies long, whs array<long>")
    return out.select("anchor", "bid", "copies", F.posexplode("whs").alias("at", "wh"))


def representatives(windows: DataFrame) -> DataFrame:
    """(anchor, part, places) of windows that occur twice: in the bodies whose bid has this remainder, (at, s1, s2) of each window they stand for.

    Every place of a window adds a number of its body to s1, and that times its position to s2, modulo M. Where a window is
    always followed by another, the other has the same s1, and an s2 that is larger by s1.
    """
    part = F.pmod("bid", F.lit(M))
    seen = windows.groupBy("anchor", "wh").agg(
        F.sum("copies").alias("n"), F.min(part * (1 << 32) + F.col("at")).alias("place"),
        F.sum(F.col("copies") * part).alias("s1"), F.sum(F.col("copies") * (part * F.col("at") % M)).alias("s2"),
    )
    twice = seen.filter("n > 1").select("anchor", F.floor(F.col("place") / (1 << 32)).cast("long").alias("part"), F.struct((F.col("place") % (1 << 32)).alias("at"), (F.col("s1") % M).alias("s1"), (F.col("s2") % M).alias("s2")).alias("place"))
    return twice.groupBy("anchor", "part").agg(F.collect_list("place").alias("places"))


def passages_of(bodies: DataFrame, window: int) -> DataFrame:
    """(anchor, passage): of bodies (anchor, places, body) the maximal runs of windows that stand for others and always follow one another, as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            out = []
            for anchor, places, body in zip(*(b.column(x).to_pylist() for x in range(3)), strict=True):
                _, s, e, raw = words(body)
                at, s1, s2 = np.array(sorted((x["at"], x["s1"], x["s2"]) for x in places), np.int64).T
                # A body with the same remainder may be shorter than the one that is meant.
                at, s1, s2 = (x[at + window <= len(s)] for x in (at, s1, s2))
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (s1[1:] != s1[:-1]) | (s2[1:] != (s2[:-1] + s1[:-1]) % M)][: len(at)])
                out += [(anchor, joined(raw, s, e, at[i], j - i + window - 1)) for i, j in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True)]
            a, p = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.string())], ["anchor", "passage"])

    return bodies.select("anchor", "places", "body").mapInArrow(run, "anchor long, passage string")


def beside(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (anchor, bid, copies, body) once for each of their keys: adds side, a hash of the words on one side of the anchor.

    A passage, in which bid is null, gets the key of one side on which it has half a window's words beyond its anchor; every
    body that holds it has the same words there, and gets the keys of both sides of every place of the anchor.
    """
    half = (window - gram + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            at, side = [], []
            for i, (anchor, bid, body) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                h = words(body)[0]
                g, near = signed(grams(h, gram)), signed(grams(h, half))
                of = np.flatnonzero(g == anchor)
                left, right = of - half, of + gram
                keys = [*near[left[left >= 0]].tolist(), *(~near[right[right + half <= len(h)]]).tolist()]
                keys = keys[:1] if bid is None else set(keys)
                at += [i] * len(keys)
                side += keys
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(side, pa.int64())], ["anchor", "bid", "copies", "body", "side"])

    return rows.select("anchor", "bid", "copies", "body").mapInArrow(run, "anchor long, bid long, copies long, body string, side long")


def located(rows: DataFrame) -> DataFrame:
    """(anchor, bid, start, stop): which words of each body the passages of its shard cover.

    Rows (anchor, side, salt, parts, bid, copies, body) come sorted, the passages of a shard (bid null) before the bodies. An
    automaton holds the passages of as many shards as fit AUTOMATON_BYTES.
    """

    def scan(patterns: dict[str, int], whole: bool, held: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        auto = ahocorasick.Automaton()
        for p, (text, n) in enumerate(patterns.items()):
            auto.add_word(text, (len(text), n, p))
        auto.make_automaton()
        found, times = [], {}
        for k, (_, _, copies, body) in enumerate(held):
            blanks = np.flatnonzero(np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            for end, (length, n, p) in auto.iter(body):
                found.append((k, int(np.searchsorted(blanks, end - length + 1)), n, p))
                times[p] = times.get(p, 0) + copies
        # Where all bodies of a shard are here, a passage that stands once was no repeat.
        found = sorted((k, s, n) for k, s, n, p in found if times[p] > 1 or not whole)
        out: list[list[int]] = []
        last, stop = -1, -1
        for k, s, n in found:
            if k != last or s > stop:
                out.append([held[k][0], held[k][1], s, s + n])
                last, stop = k, s + n
            elif s + n > stop:
                out[-1][3] = stop = s + n
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "bid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[str, int] = {}
        held: list[tuple[int, int, int, str]] = []
        shard, size, parted = None, 0, False
        for b in small(batches, 256):
            for anchor, side, salt, parts, bid, copies, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (anchor, side, salt) != shard and held and (size >= AUTOMATON_BYTES or parts > 1 or parted):
                    yield scan(patterns, not parted, held)
                    patterns, held, size = {}, [], 0
                shard, parted = (anchor, side, salt), parts > 1
                if bid is None:
                    patterns[body] = body.count(" ") - 1
                else:
                    held.append((anchor, bid, copies, body))
                size += len(body)
                if parted and held and size >= 4 * AUTOMATON_BYTES and len(held) >= len(patterns):
                    # A dealt shard has the passages once and its bodies bit by bit.
                    yield scan(patterns, False, held)
                    held, size = [], 0
        if patterns and held:
            yield scan(patterns, not parted, held)

    return rows.select("anchor", "side", "salt", "parts", "bid", "copies", "body").mapInArrow(run, "anchor long, bid long, start long, stop long")


def cut_out(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_removed and kept to docs (.., text, spans): the words outside the spans, joined by one blank."""
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    text, spans = docs.columns.index("text"), docs.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            n, gone, kept = [], [], []
            for t, ranges in zip(b.column(text).to_pylist(), b.column(spans).to_pylist(), strict=True):
                _, s, e, raw = words(t)
                out = np.zeros(len(s) + 1, np.int32)
                for r in ranges or ():
                    out[r["start"]] += 1
                    out[r["stop"]] -= 1
                keep = np.flatnonzero(np.cumsum(out[:-1]) == 0)
                n.append(len(s))
                gone.append(len(s) - len(keep))
                # Words that stay in a row are one slice.
                cut = np.flatnonzero(np.diff(keep) > 1)
                runs = zip(keep[np.r_[0, cut + 1]], keep[np.r_[cut, -1]], strict=True) if len(keep) else ()
                kept.append(b" ".join(spaced(raw[s[i] : e[j]]) for i, j in runs).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, n_words, n_removed, kept): each row's words outside all windows that occur elsewhere, the same row included.

    A null text has no words. A row that repeats another with as many words as a window is removed whole, and so is the
    other; a text with fewer words stays as it is. Null keys are keys. An empty table gives an empty one. Only the named
    columns are looked at.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.lit(1), key).alias("doc"), F.xxhash64(F.col(key).isNull(), text).alias("th"))
    recurring = scratch.put(recurring_anchors(own, "text", window, gram))
    scratch.sweep()
    cut = scratch.put(pieces(own, recurring, window, gram).withColumn("bid", F.xxhash64("body")))
    scratch.drop(recurring)
    bodies = scratch.put(cut.groupBy("anchor", "bid", "body", "multi").agg(F.count("*").alias("copies")))
    kinds = scratch.put(bodies.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all"), F.max("multi").alias("many")).filter("all > 1 OR many"))
    judged = bodies.join(kinds.hint("merge"), "anchor").withColumn("alone", F.expr("kinds = 1 AND NOT many"))
    judged = scratch.put(judged.select("anchor", "bid", "body", "copies", "alone"))
    scratch.drop(bodies, kinds)
    whole, several = judged.filter("alone"), judged.filter("NOT alone")
    stand = representatives(windows_of(several, window)).withColumnRenamed("anchor", "a2")
    stand = several.join(stand.hint("merge"), (F.col("anchor") == F.col("a2")) & (F.pmod("bid", F.lit(M)) == F.col("part")))
    passages = scratch.put(passages_of(stand, window).distinct())
    scratch.sweep()
    # Anchors with a passage, and the number of their bodies.
    sizes = several.groupBy("anchor").agg(F.count("*").alias("rows")).join(passages.select(F.col("anchor").alias("a2")).distinct().hint("merge"), F.col("anchor") == F.col("a2"), "left_semi")
    sizes = scratch.put(sizes.select("anchor", "rows"))
    every = several.select("anchor", "bid", "copies", "body").unionByName(passages.select("anchor", F.lit(None).cast("long").alias("bid"), F.lit(0).cast("long").alias("copies"), F.col("passage").alias("body")))
    few = every.join(sizes.filter(F.col("rows") <= shard_rows).select("anchor").hint("merge"), "anchor").withColumns({"side": F.lit(0).cast("long"), "parts": F.lit(1)})
    dealt = scratch.put(beside(every.join(sizes.filter(F.col("rows") > shard_rows).select("anchor").hint("merge"), "anchor"), window, gram))
    # Keys without a passage hold nothing to be found.
    parts = dealt.groupBy("anchor", "side").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.bool_or(F.col("bid").isNull()).alias("some"))
    parts = scratch.put(parts.filter("some").drop("some"))
    dealt = dealt.join(parts.hint("merge"), ["anchor", "side"])
    alone = whole.select("anchor", F.explode(F.array(F.lit(None).cast("long"), "bid")).alias("bid"), "copies", "body").withColumns({"side": F.lit(0).cast("long"), "parts": F.lit(1)})
    columns = ["anchor", "side", "salt", "parts", "bid", "copies", "body"]
    salts = F.when(F.col("bid").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("bid", "body"), "parts").cast("int")))
    rows = few.unionByName(alone).withColumn("salt", F.lit(0)).select(columns).unionByName(dealt.withColumn("salt", F.explode(salts)).select(columns))
    found = scratch.put(located(rows.repartition("anchor", "side", "salt").sortWithinPartitions("anchor", "side", "salt", F.col("bid").asc_nulls_first())))
    scratch.drop(judged, passages)
    spans = cut.select("doc", "th", "anchor", "bid", "first").join(found.hint("merge"), ["anchor", "bid"])
    spans = spans.groupBy("doc", "th").agg(F.collect_set(F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))).alias("spans"))
    spans = scratch.put(spans)
    scratch.drop(cut, found)
    return cut_out(own.join(spans.hint("merge"), ["doc", "th"], "left").select("key", "text", "spans")).select(F.col("key").alias(key), "n_words", "n_removed", "kept")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN rep USING (h), range(0, 35) r(j)),
word AS (SELECT doc_id, i, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
