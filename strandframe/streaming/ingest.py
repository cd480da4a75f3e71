"""File-source streams: sequence and call files that keep arriving, with the same column functions as the batch side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import composition


def flat_sequences(spark: SparkSession, path: str, *, sep: str = "\t", per_trigger: int = 64) -> DataFrame:
    """(label, seq) of tab-separated files as they appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path).filter(F.length(F.trim("value")) > 0)
    p = F.split("value", f"\\Q{sep}\\E", 2)
    return lines.select(F.trim(p[0]).alias("label"), F.trim(F.get(p, 1)).alias("seq"))


def running_composition(stream: DataFrame) -> DataFrame:
    """Counts of the symbols over all sequences so far."""
    return stream.agg(*[F.sum(c).alias(f"n_{'gap' if b == '-' else b.lower()}") for b, c in composition(F.col("seq")).items()])
