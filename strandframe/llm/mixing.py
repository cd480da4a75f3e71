"""Operator 4: mixing sources to target weights by entropy balancing, on DataFrame functions alone.

The mix is the set of document rates nearest, in relative entropy, to one copy of each document, under one token
constraint per source and an upper bound on every rate. Its dual has one multiplier per source: the rate of a document of
size x is min(cap, exp(lambda * x / mean size)). Newton steps, guarded by a bracket, solve the dual. They run over a
histogram (source, size) -> documents, which is far smaller than the documents; the multipliers stay in a table with one
row per source, and only the largest relative error comes to the driver. Rates become whole copies by carrying fractions
from bin to bin in descending size; two passes then mend each source's remainder with the one bin that fits it best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, clear_of, n_words, table, without

#: Parts into which equal-sized documents of a source are dealt, so that none of them has to be ranked in one task: so many at
#: least, and so many more that a part of a size that every document has holds this many.
SALTS, PART_ROWS = 64, 1 << 16
#: Sums over bins are decimals, so that their order does not matter and reruns agree.
EXACT = "decimal(38,9)"


def targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Adds target: shares of all tokens by cycling weights, in code point order of the source (null last), none above cap times its size.

    The level at which the capped shares use up all tokens is the largest of the levels that follow from taking the first k
    sources, by size over weight, as capped.
    """
    every, ordered = Window.partitionBy(), Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(ordered) - 1) % len(weights) + 1
    full = F.col("s_size") * F.lit(float(cap))
    before = Window.partitionBy().orderBy(full / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("s_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("weight") * F.col("level"), full))
        .drop("level")
    )


def tilts(scratch: Scratch, bins: DataFrame, sources: DataFrame, cap: float, tolerance: float, max_iter: int) -> DataFrame:
    """Solves the dual: sources with lam, and held where the rate is the same for all (1 without tokens, cap at a full target). Raises if max_iter steps don't."""
    held = F.when(F.col("s_size") == 0, F.lit(1.0)).when(F.col("target") >= F.col("s_size") * (cap * (1 - 1e-12)), F.lit(float(cap)))
    start = sources.withColumn("held", held).withColumns({"lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "err": F.lit(1.0)})
    state = scratch.put(start.withColumn("mean", F.col("s_size") / F.col("s_docs")))
    for _ in range(max_iter):
        raw = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
        tokens = F.col("n") * F.col("size")
        grad = (
            bins.join(state.filter(F.col("held").isNull()).select("skey", "lam", "mean"), "skey")
            .groupBy("skey")
            .agg(
                F.sum((tokens * F.least(raw, F.lit(float(cap)))).cast(EXACT)).cast("double").alias("g"),
                F.sum(F.when(raw < cap, tokens * F.col("size") / F.col("mean") * raw).otherwise(0.0).cast(EXACT)).cast("double").alias("h"),
            )
        )
        over = F.col("g") > F.col("target")
        moved = state.join(grad, "skey", "left").withColumns({
            "hi": F.when(over, F.col("lam")).otherwise(F.col("hi")),
            "lo": F.when(~over, F.col("lam")).otherwise(F.col("lo")),
            "err": F.when(F.col("held").isNotNull(), F.lit(0.0)).otherwise(F.abs(F.col("g") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))),
            "step": F.col("lam") - F.try_divide(F.col("g") - F.col("target"), F.col("h")),
        })
        # A Newton step counts only inside the bracket; else halve the bracket, or double away from zero while it is open.
        middle = (F.col("lo") + F.col("hi")) / 2
        far = F.when(F.col("lo").isNull(), F.col("hi") - 1 - F.abs(F.col("hi"))).otherwise(F.col("lo") + 1 + F.abs(F.col("lo")))
        good = F.col("step").isNotNull() & (F.col("lo").isNull() | (F.col("step") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("step") < F.col("hi"))) & (F.abs(F.col("step") - F.col("lam")) < 4)
        new = F.when(F.col("err") <= tolerance, F.col("lam")).when(good, F.col("step")).otherwise(F.coalesce(middle, far))
        last, state = state, scratch.put(moved.withColumn("lam", F.when(F.col("held").isNull(), new).otherwise(F.col("lam"))).select(state.columns))
        done = state.agg(F.max("err")).first()[0]
        scratch.drop(last)
        if done is None or done <= tolerance:
            return state
    raise ArithmeticError(f"the dual is not solved after {max_iter} steps: the largest relative error of a source is {done}")


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3,
    tolerance: float = 1e-6, max_iter: int = 200,
) -> DataFrame:
    """Adds size, source_size, target, copies and taken (= copies * size) to every row of docs.

    A null text has size 0; documents of size 0 keep one copy. A null source is a source of its own, after all others. Rows
    that repeat are documents of their own. An empty table gives an empty one. Extra columns pass through; columns of the
    added names are replaced. The outcome depends on the rows alone, not on their order or partitioning.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = without(docs, "size", "source_size", "target", "copies", "taken")
    w = clear_of(docs.columns, "skey", "order", "salt", "rank")
    sized = docs.withColumns({
        "size": n_words(F.col(text)),
        w["skey"]: F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(source))),
        w["order"]: F.xxhash64(F.col(key), F.col(text)),
    }).withColumn(w["salt"], F.pmod(w["order"], F.lit(max(SALTS, docs.count() // PART_ROWS))))
    parts = scratch.put(sized.groupBy(F.col(w["skey"]).alias("skey"), F.col(source).alias("source"), "size", F.col(w["salt"]).alias("salt")).agg(F.count("*").alias("n")))
    bins = scratch.put(parts.groupBy("skey", "source", "size").agg(F.sum("n").alias("n")))
    sources = bins.groupBy("skey", "source").agg(F.sum(F.col("n") * F.col("size")).alias("s_size"), F.sum("n").alias("s_docs"))
    state = tilts(scratch, bins, targets(sources, weights, cap), cap, tolerance, max_iter)

    rate = F.coalesce("held", F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    down = Window.partitionBy("skey").orderBy(F.col("size").desc())
    mass = F.round(F.sum(F.col("n") * F.col("rate")).over(down)).cast("long")
    whole = (
        bins.join(state.select("skey", "s_size", "target", "held", "lam", "mean"), "skey")
        .withColumn("rate", rate)
        .withColumn("upto", mass)
        .withColumn("k", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
        .select("skey", "size", "n", "s_size", "target", "k")
    )
    done = [bins, state]
    for _ in range(2):
        rest = whole.groupBy("skey").agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("rest"))
        change = F.greatest(-F.col("k"), F.least(F.col("n") * cap - F.col("k"), F.round(F.try_divide(F.col("rest"), F.col("size"))).cast("long")))
        fit = (
            whole.join(rest, "skey").filter(F.col("size") > 0).withColumn("d", change)
            .groupBy("skey").agg(F.min(F.struct(F.abs(F.col("rest") - F.col("d") * F.col("size")).alias("off"), F.abs("d").alias("far"), "size", "d")).alias("best"))
            .select("skey", F.col("best.size").alias("size"), F.col("best.d").alias("d"))
        )
        whole = scratch.put(whole.join(fit, ["skey", "size"], "left").withColumn("k", F.col("k") + F.coalesce("d", F.lit(0))).drop("d"))
        scratch.drop(*done)
        done = [whole]

    # Copies of a bin go to its parts in proportion, and inside a part to the documents of the smallest hashes.
    along = Window.partitionBy("skey", "size").orderBy("salt")
    cum = F.sum("m").over(along)
    extra = F.col("k") % F.col("n")
    share = (
        parts.withColumnRenamed("n", "m").join(whole, ["skey", "size"])
        .withColumn("base", (F.col("k") - extra) / F.col("n"))
        .withColumn("base", F.col("base").cast("long"))
        .withColumn("cum", cum)
        .withColumn("more", F.floor(extra * F.col("cum") / F.col("n")) - F.floor(extra * (F.col("cum") - F.col("m")) / F.col("n")))
        .select(F.col("skey").alias(w["skey"]), "size", F.col("salt").alias(w["salt"]), F.col("s_size").alias("source_size"), "target", "base", "more")
    )
    taken = {c.lower() for c in docs.columns} & {"base", "more"}
    share = share.withColumnsRenamed({c: f"{c}__" for c in taken})
    base, more = (f"{c}__" if c in taken else c for c in ("base", "more"))
    by = [w["skey"], "size", w["salt"]]
    ranked = sized.withColumn(w["rank"], F.row_number().over(Window.partitionBy(*by).orderBy(w["order"], key)))
    return (
        ranked.join(share, by)
        .withColumn("copies", F.col(base) + F.when(F.col(w["rank"]) <= F.col(more), 1).otherwise(0))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*docs.columns, "size", "source_size", "target", "copies", "taken")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
