"""Five stages that turn a table of documents into a training mix; counted as part of the optional subpackage llm.

Every stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, and no others, whatever columns more the documents have. Any of these may be null;
an empty table of documents gives an empty one, and an empty benchmark removes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm import decontamination, jaccard_join, language, lines, mixing
from strandframe.llm.common import WORD, Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text's n-grams that its language must know; what has less is in none of the learned languages.
LEAST_SCORE = 0.3

#: Near copies share 80 % of their five-word shingles.
NEAR = jaccard_join.Rule(k=5, num=80, den=100)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null texts among them, and those whose n-grams no learned language knows. Without any labelled document none is learned and all go."""
    found = language.identify(docs, language.learn(docs))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated chunks of lines; documents of which nothing is left go. n_chars follows the text. Rows that repeat come out alike; texts without words, or null, that lose nothing stay."""
    kept = lines.dedup_lines(docs).filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(WORD))
    return kept.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once if its row repeats; texts without words link with nothing and stay.

    A document is its doc_id and text together, so of two rows with one doc_id each follows the group of its own text. Where
    one doc_id names a group in several texts, these stay.
    """
    groups = jaccard_join.join_components(docs.select("doc_id", "text"), rule=NEAR)
    stays = groups.filter(F.col("class_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct(F.col("doc_id").alias("v"), F.col("text_hash").alias("th")).alias("k")).distinct()
    boxed = docs.select(COLUMNS).withColumns({"key": F.struct(F.col("doc_id").alias("v"), F.xxhash64("text").alias("th"))})
    kept = boxed.join(stays.hint("merge"), F.col("key") == F.col("k"), "left_semi")
    again = F.row_number().over(Window.partitionBy("key").orderBy("lang", "source"))
    return kept.withColumn("again", again).filter((F.col("again") == 1) | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item: all rows with the doc_id of one that does. Null texts hold none and stay."""
    held = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.struct(F.col("doc_id").alias("v")).alias("k")).distinct()
    return docs.join(held.hint("merge"), F.struct(F.col("doc_id").alias("v")) == F.col("k"), "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as it has copies, numbered from 1; documents without a copy go. A null text has size 0 and one copy, a null source is a source of its own, rows that repeat are mixed one by one."""
    mixed = mixing.mix(docs).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*COLUMNS, "size", "source_size", "target", "copies", "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("source_mix", mix),
]

#: Learned filters, 64-bit hashes and Newton's method are not SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
