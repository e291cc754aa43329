"""Evaluation: class statistics of two feature sets and the distance between them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from captionforge.operators.stats import class_stats, frechet_distance


def frechet_per_class(real: DataFrame, generated: DataFrame, label: str, vector: str, key: list[str]) -> DataFrame:
    return frechet_distance(
        class_stats(real, label, vector, key), class_stats(generated, label, vector, key), label)
