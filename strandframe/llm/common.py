"""What the corpus operators share: the word rule, the shared folder, and tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, shared_dir

__all__ = ["WORD", "Scratch", "clear_of", "n_words", "shared_dir", "table", "without"]

#: A word is a run of anything but the ASCII blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear_of(columns: list[str], *names: str) -> dict[str, str]:
    """Working column names that no input column has, whatever extra columns the input carries."""
    taken = {c.lower() for c in columns}
    out = {}
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out[name] = new
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame less the columns that an operator is about to add: those of the input are replaced."""
    return df.drop(*[c for c in df.columns if c.lower() in names])
