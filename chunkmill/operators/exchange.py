"""Export and import: what one repository has and another lacks, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def missing(source: DataFrame, target: DataFrame, on: str = "path") -> DataFrame:
    """Rows of source whose name target does not have; content is not compared."""
    return source.join(target.select(on).distinct(), on, "left_anti")


def exchanged(source: DataFrame, target: DataFrame, on: str = "path") -> DataFrame:
    """target after the transfer; a name that exists is left alone."""
    return target.unionByName(missing(source, target, on).select(target.columns))
