"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search.

The items are short and the documents long. An item with n shingles is put into a size class (a power of two), and its sketch
is its s smallest shingle hashes, s following from the upper bound of the class, so that a text holding a share of at least
`threshold` of the shingles cannot miss all of them (it lacks at most (1 - threshold) * n). Each class is an index of its own,
from the hashes of its sketches to its items. A document is searched whole: its shingles are looked up among the sketches,
never among all shingles of the items, and a hit makes a candidate. The shingles that document and items may have in common
then decide the candidates, and these alone, by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .marks import has_mark, marks
from .tokens import U, grams, list_array, signed, small, words

SHINGLE = 5
THRESHOLD = 0.8
#: Size classes are powers of two.
CLASS = 2


def _lengths(texts: list[str | None], ks: tuple[int, ...]) -> Iterator[np.ndarray]:
    for t in texts:
        h = words(t, lower=True)[0]
        yield np.concatenate([np.zeros(0, U), *(np.unique(grams(h, k)) for k in ks)])


def item_shingles(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item_id, k, n, h): each item's distinct shingles; an item of fewer than SHINGLE words is one shingle of its length k."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids, ks, ns, hs = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = words(t, lower=True)[0]
                k = min(SHINGLE, len(h))
                if k:
                    s = np.unique(grams(h, k))
                    ids += [i] * len(s)
                    ks += [k] * len(s)
                    ns += [len(s)] * len(s)
                    hs.append(signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(ks, pa.int32()), pa.array(ns, pa.int64()), pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64))], ["item_id", "k", "n", "h"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key), F.col(text)).mapInArrow(cut, f"item_id {kind}, k int, n long, h long")


def sketched(items: DataFrame, threshold: float) -> DataFrame:
    """(class, h, item_id) of items (item_id, n, hs), hs sorted: the s smallest shingles, s = floor((1 - threshold) * upper bound of the size class) + 1."""
    by = F.ceil(F.log(float(CLASS), F.col("n").cast("double"))).cast("int")
    s = F.floor((1 - threshold) * F.pow(F.lit(float(CLASS)), by) + 1e-9).cast("int") + 1
    return items.select(by.alias("class"), "item_id", F.explode(F.slice("hs", F.lit(1), F.least(F.col("n").cast("int"), s))).alias("h"))


def searched(docs: DataFrame, text: str, key: str, ks: tuple[int, ...], sketches: np.ndarray, every: np.ndarray) -> DataFrame:
    """(id, found, held) of documents: shingles that may be in a sketch, and all that items may have; documents without any are left out.

    The bitmaps have a fixed size, whatever the benchmark's: more items only let more shingles pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sketches, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_sketches, in_items = shared.value
        for b in small(batches):
            at, found, held = [], [], []
            for i, h in enumerate(_lengths(b.column(1).to_pylist(), ks)):
                h = h[has_mark(in_items, h)]
                if len(h):
                    at.append(i)
                    found.append(signed(h[has_mark(in_sketches, h)]))
                    held.append(signed(h))
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), list_array(found, pa.int64()), list_array(held, pa.int64())], ["id", "found", "held"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"id {kind}, found array<long>, held array<long>")


def contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document key and item of which the document has at least `threshold` of the distinct shingles: key, item key, n_shared, n_item, containment.

    Words are lower-cased (A-Z). Null texts, and texts without words, match nothing; items without words match nothing.
    Rows that share a key are taken as one document (the union of their shingles); so are items. A null key is a key of its
    own. Empty tables give an empty result. Only the named columns are looked at.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    items = items.select(F.struct(F.col(item_key).alias("v")).alias("item"), F.col(item_text).alias("text"))
    cut = scratch.put(item_shingles(items.withColumn("j", F.to_json("item")).select("text", "j"), "text", "j"))
    ks = tuple(sorted(r["k"] for r in cut.select("k").distinct().collect()))
    by_item = scratch.put(cut.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs")).withColumn("n", F.size("hs").cast("long")))
    sketches = scratch.put(sketched(by_item, threshold))
    hit = scratch.put(searched(docs, text, key, ks, marks(sketches, "h"), marks(cut, "h")))
    boxed = hit.select(F.struct(F.col("id").alias("v")).alias("doc"), "found", "held")
    # Candidates are told by pairs of keys; a document's shingles meet those of an item once for each of them.
    pairs = boxed.select("doc", F.explode("found").alias("h")).join(sketches.select("h", "item_id"), "h").select("doc", "item_id").distinct()
    pairs = scratch.put(pairs)
    scratch.drop(cut, sketches)
    held = boxed.select(F.col("doc").alias("of"), "held")
    met = pairs.join(held.hint("merge"), F.col("doc") == F.col("of")).join(by_item.select(F.col("item_id").alias("is"), "hs", "n"), F.col("item_id") == F.col("is"))
    # A row of the document holds this much of the item; rows that share a key are joined before they are counted.
    both = met.select("doc", "item_id", "n", F.array_intersect("hs", "held").alias("both"))
    one = both.groupBy("doc", "item_id", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_set("both")))).cast("long").alias("n_shared"))
    exact = one.withColumn("containment", F.col("n_shared") / F.col("n")).filter(F.col("containment") >= threshold)
    item = F.from_json("item_id", items.select("item").schema["item"].dataType)["v"]
    return exact.select(F.col("doc.v").alias(key), item.alias(item_key), "n_shared", F.col("n").alias("n_item"), "containment")


def op7_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Exact containment by words; the operator's hashes only stand for these.
OP7_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
iwords AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM words)),
ish AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM iwords)),
n AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sh JOIN ish USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN n USING (item_id) WHERE n_shared / n_item >= 0.8
"""
