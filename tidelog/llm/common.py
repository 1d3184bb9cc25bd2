"""What the operators share: white space, words, saved tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.session import fresh_folder

# The ASCII white space that separates words, as text and as a pattern.
WHITE = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and no lost
    executor makes it be computed anew."""
    folder = fresh_folder(df.sparkSession, f"llm-{label}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    lowered = {c.lower() for c in taken}
    while name in lowered:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space. NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
