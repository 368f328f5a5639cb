"""Prompts as they come: the evaluator is a projection, so a stream takes it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompt_risk import prompt_risk


def score_stream(prompts: DataFrame, column: str = "text") -> DataFrame:
    return prompts.withColumn("risk", prompt_risk(F.col(column))).select("*", "risk.*").drop("risk")


def level_counts(scored: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """How many prompts of each level came in each window; what is later than `late` is dropped."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window), "level").agg(F.count("*").alias("n"))
