"""Python workers must be able to import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Put the folder that holds the package on the workers' path; it matters where the package is neither installed nor shipped."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
