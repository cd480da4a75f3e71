"""Operator 6: line dedup by content-defined chunks of lines, on DataFrame functions alone.

A rolling hash over the hashes of neighbouring lines (a polynomial modulo a prime) marks where a chunk may end. Of marks that
follow one another directly every other one counts, so chunks have two lines at least, but for the ends of a text; boundaries
depend on the lines around them and not on their position: a passage put into another document is soon cut alike.
Chunks of several lines that occur more than once in the whole table are removed wherever their bytes equal those of an
earlier occurrence; the first one, by document and position, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, clear_of, table, without

#: Lines that roll into one hash, the polynomial's base and prime, and the share of hashes (of 16) after which a chunk may end.
ROLL, BASE, PRIME = 2, 31, 2**31 - 1
ENDS = 10


def chunks(text: Column) -> Column:
    """The text as an array of chunks (pos, lines, body), whose bodies joined by line feeds give the text again."""
    hashed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long").alias("h")))
    return F.flatten(F.transform(F.array(hashed), lambda lines: F.flatten(F.transform(F.array(_stops(lines)), lambda s: _between(lines, s)))))


def _stops(lines: Column) -> Column:
    """The last lines of the chunks: every other one of a run of marked lines, and the end of the text."""
    n = F.size(lines)

    def rolled(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for j in reversed(range(ROLL)):
            out = out * BASE + F.coalesce(F.get(lines, i - j)["h"], F.lit(0))
        return out % PRIME

    marked = F.array_join(F.transform(lines, lambda x, i: F.when(rolled(i) % 16 < ENDS, F.lit("1")).otherwise(F.lit("0"))), "")
    # In a run of ones the pairs turn into "10" from the left, which leaves every other one.
    flags = F.split(F.replace(marked, F.lit("11"), F.lit("10")), "")
    return F.flatten(F.transform(F.array(flags), lambda f: F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get(f, i) == "1"))))


def _between(lines: Column, stops: Column) -> Column:
    return F.transform(stops, lambda stop, k: _chunk(lines, F.coalesce(F.get(stops, k - 1), F.lit(-1)) + 1, stop, k))


def _chunk(lines: Column, start: Column, stop: Column, k: Column) -> Column:
    body = F.array_join(F.transform(F.slice(lines, start + 1, stop - start + 1), lambda x: x["line"]), "\n")
    return F.struct(k.alias("pos"), (stop - start + 1).alias("lines"), body.alias("body"))


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Returns docs with repeated multi-line chunks taken out of text, and adds n_lines and n_removed_lines.

    A document of which nothing is left has the text ''. A null text stays null, with 0 lines. Rows alike in key and text
    are the same occurrence and come out alike, whole unless an earlier document holds their chunks; a null key comes last
    in the order of occurrences. Empty tables give empty ones; other columns pass through, whatever their names, but
    columns of the two added names are replaced.
    """
    docs = without(docs, "n_lines", "n_removed_lines")
    scratch = Scratch(docs.sparkSession, "lines")
    w = clear_of(docs.columns, "th", "k2", "t2", "gone", "cs")
    hashed = docs.withColumn(w["th"], F.xxhash64(text))
    own = hashed.select(F.col(key).alias("key"), F.col(w["th"]).alias("th"), F.col(text).alias("text"))
    # What is joined to the texts grows with them, so it is never broadcast; both joins read one exchange if there are no other columns.
    same = F.col(key).eqNullSafe(F.col(w["k2"])) & F.col(w["th"]).eqNullSafe(F.col(w["t2"]))
    # Which chunk hashes occur twice: shuffles one number per chunk, summed before.
    marks = own.select("key", "th", F.explode(F.transform(F.filter(chunks(F.col("text")), lambda c: c["lines"] > 1), lambda c: F.struct(c["pos"].alias("pos"), F.xxhash64(c["body"]).alias("ch")))).alias("c"))
    marks = scratch.put(marks.select("key", "th", "c.pos", "c.ch"))
    # Written before it is joined, so that both sides of the join are plain exchanges, which Spark splits where one chunk is very common.
    often = scratch.put(marks.groupBy("ch").agg(F.count("*").alias("n")).filter("n > 1").select("ch"))
    at = scratch.put(marks.join(often, "ch").groupBy("key", "th").agg(F.collect_set("pos").alias("at")))
    scratch.drop(marks, often)
    # The bytes of those chunks, from the documents that hold them.
    seen = at.withColumnsRenamed({"key": w["k2"], "th": w["t2"], "at": w["gone"]}).hint("merge")
    found = hashed.join(seen, same).select(F.col(key).alias("key"), F.col(w["th"]).alias("th"), F.explode(F.filter(chunks(F.col(text)), lambda c: F.array_contains(w["gone"], c["pos"]))).alias("c"))
    bodies = scratch.put(found.select("key", "th", "c.pos", "c.body", F.xxhash64("c.body").alias("ch")))
    order = F.struct(F.col("key").isNull().alias("last"), "key", "th", "pos")
    first = scratch.put(bodies.groupBy("ch", "body").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    # Equal bytes are asked for again where a chunk is struck out, so a chance equality of hashes removes nothing.
    struck = bodies.join(first.select("ch", F.col("body").alias("same"), "first"), "ch").filter((F.col("body") == F.col("same")) & (order != F.col("first")))
    struck = struck.groupBy("key", "th").agg(F.collect_set("pos").alias("gone"))
    struck = scratch.put(struck)
    scratch.drop(at, bodies, first)
    struck = struck.withColumnsRenamed({"key": w["k2"], "th": w["t2"], "gone": w["gone"]}).hint("merge")
    joined = hashed.join(struck, same, "left")
    cs = F.when(F.col(w["gone"]).isNotNull(), chunks(F.col(text)))
    kept = F.filter(w["cs"], lambda c: ~F.array_contains(w["gone"], c["pos"]))
    gone = F.aggregate(F.filter(w["cs"], lambda c: F.array_contains(w["gone"], c["pos"])), F.lit(0), lambda a, c: a + c["lines"])
    new = F.when(F.col(w["gone"]).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda c: c["body"]), "\n"))
    lines = F.coalesce(F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return joined.withColumn(w["cs"], cs).select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], lines.alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed_lines")
    )


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


#: The same in SQL; DuckDB lists are 1-based.
OP6_SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, i, ls[i] AS line, i = len(ls) AS last, CAST('0x' || substr(md5(ls[i]), 1, 7) AS BIGINT) AS h FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)),
rolled AS (SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h) % 2147483647 % 16 < 10 AS marked FROM each),
flags AS (SELECT doc_id, replace(string_agg(CASE WHEN marked THEN '1' ELSE '0' END, '' ORDER BY i), '11', '10') AS f FROM rolled GROUP BY doc_id),
ends AS (SELECT doc_id, i, line, last OR f[i] = '1' AS stop FROM rolled JOIN flags USING (doc_id)),
numbered AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ends),
cut AS (SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, pos),
judged AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, pos) > 1 AS gone FROM cut),
found AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed_lines,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN body END, chr(10) ORDER BY pos), '')) AS kept_sha256 FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, CASE WHEN text IS NOT NULL THEN kept_sha256 END AS kept_sha256
FROM documents LEFT JOIN found USING (doc_id)
"""
