"""Operator 2: threshold-scaled document fingerprints, on DataFrame functions alone.

A document's sketch is every hash of a five-word shingle that lies in the lowest FRACTION of the hash range. Because the
threshold is the same for all documents, the sketch of a union is the union of sketches, and containment of a short text in
a very long one can be estimated as well as resemblance. A document none of whose hashes lies below the threshold keeps its
smallest hash as an anchor, so that short texts still have a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Share of the hash range that is kept, as a power of two: 1/4.
KEPT_BITS = 2
SHINGLE = 5
THRESHOLD = -(2**63) + (2**64 >> KEPT_BITS)


def sketch(text: Column, k: int = SHINGLE, threshold: int = THRESHOLD) -> Column:
    """Sorted distinct kept hashes of the text's k-word shingles (array of long).

    Words are maximal runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer than k words is one
    shingle; a text without words, or a null one, has an empty sketch.
    """
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array(F.split(lowered, r"[\x20\x09-\x0D]+")), lambda ws: _of_words(F.array_remove(ws, ""), k, threshold))[0]


def _of_words(words: Column, k: int, threshold: int) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashed), lambda h: _of_hashes(h, k, threshold))[0]


def _of_hashes(h: Column, k: int, threshold: int) -> Column:
    n = F.size(h)
    each = F.transform(F.slice(h, 1, F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
    whole = F.transform(F.filter(F.array(n), lambda m: (m > 0) & (m < k)), lambda m: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    every = F.when(n >= k, each).otherwise(whole)
    return F.transform(F.array(every), lambda hs: F.transform(F.array(F.filter(hs, lambda x: x < threshold)), lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.slice(F.array_sort(hs), 1, 1)))[0])[0]


def hexed(hashes: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits a hash, in the order of the sketch."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that are in b; 1 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(1.0))


def merged(sketches: Column, threshold: int = THRESHOLD) -> Column:
    """The sketch of a union of documents, from an array of their sketches; anchors give way to hashes below the threshold."""
    every = F.array_sort(F.array_distinct(F.flatten(sketches)))
    low = F.filter(every, lambda x: x < threshold)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1))


def followers(scratch: Scratch, keys: DataFrame) -> DataFrame:
    """Adds next to distinct keys (columns key, n): the next smaller key, for the smallest (null is last of all) the largest.

    Keys are dealt by range; inside a range a window finds the next key, and one row per range links the ranges.
    """
    down = F.col("key").desc_nulls_last()
    dealt = scratch.put(keys.repartitionByRange(down).withColumn("part", F.spark_partition_id()))
    boxed = F.struct(F.col("key").alias("v"))
    inside = dealt.withColumn("inner", F.lead(boxed).over(Window.partitionBy("part").orderBy(down)))
    heads = dealt.groupBy("part").agg(F.struct(F.max("key").alias("v")).alias("head"))
    chain = Window.partitionBy().orderBy("part")
    ends = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(chain), F.first("head").over(ends)).alias("outer"))
    return inside.join(heads, "part").select("key", "n", F.coalesce("inner", "outer")["v"].alias("next"))


def compare_with_next(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints each document, the document edited with its follower's start, and compares both and the follower.

    The follower is the next document by descending key (null last; after the last, the first). A null text counts as
    empty. Rows that share a key are each compared with the same follower; where the follower's key has several rows, the
    one with the smallest text stands for it. An empty table gives an empty one; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    # Keys are boxed: structs with a null inside compare and hash like any others. Both joins read one exchange of the texts.
    own = docs.select(F.struct(F.col(key).alias("v")).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # n: a document lends as much of its start as the longest row of its predecessor's key replaces.
    third = F.floor(F.char_length("text") / 3).cast("int")
    lent = followers(scratch, own.groupBy(F.col("k.v").alias("key")).agg(F.max(third).alias("n")))
    lent = lent.select(F.struct(F.col("key").alias("v")).alias("to"), F.struct(F.col("next").alias("v")).alias("from"), "n")
    head = (
        own.join(lent, F.col("k") == F.col("from"))
        .select("to", F.struct(F.expr("substring(text, 1, n)").alias("start"), sketch(F.col("text")).alias("sketch")).alias("head"))
        .groupBy("to").agg(F.min("head").alias("head"))
    )
    edited = F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), substring(head.start, 1, cast(floor(n_chars / 3) as int)))")
    drawn = (
        own.join(head, F.col("k") == F.col("to"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", edited)
        .select(F.col("k.v").alias("key"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), F.col("head.sketch").alias("c"))
    )
    return drawn.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", hexed(F.col("a")).alias("fingerprint"), hexed(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("c")).alias("near_next"),
        containment(F.col("a"), F.col("b")).alias("in_edited"),
    )


def op2_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
