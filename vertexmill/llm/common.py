"""What the operators of this subpackage share: columns, checkpoints, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexmill.plans.checkpoints import checkpoint_dir, cut, written

__all__ = ["SPACE", "ascii_lower", "checkpoint_dir", "cut", "free_name", "let", "table", "words", "written"]

#: Java pattern of the ASCII white space that separates words.
SPACE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores behind it until no column of df has that name, in either case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
