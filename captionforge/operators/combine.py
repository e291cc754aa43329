"""Appending and interleaving datasets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.functions.rand import hash_uniform
from captionforge.operators.positions import with_group_index

COPIES_PER_ROW = 4096  # copies one row is expanded to before its copies are spread over tasks


def concat_rows(frames: list[DataFrame], source: str = "source_no") -> DataFrame:
    """Append datasets by column name, missing columns null, with the dataset's ordinal."""
    tagged = [df.withColumn(source, F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def add_item(df: DataFrame, item: dict) -> DataFrame:
    """Append one row; its values take the dataset's column types."""
    unknown = set(item) - set(df.columns)
    row = df.sparkSession.range(1).select(*[
        F.lit(item.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema
    ], *[F.lit(item[c]).alias(c) for c in sorted(unknown)])
    return df.unionByName(row, allowMissingColumns=True)


def _placed(rows: DataFrame, source: str, order_by: list) -> tuple[DataFrame, dict[int, int]]:
    """Rows with their position inside their source, and the length of each source."""
    placed = with_group_index(rows, [source], order_by, "__k")
    # one row per interleaved dataset
    lengths = {r[source]: r["n"] for r in placed.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    return placed, lengths


def _per_source(source: str, values: dict[int, object]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    return F.element_at(table, F.col(source))


def interleave_cycle(rows: DataFrame, source: str, order_by: list, name: str = "out_idx") -> DataFrame:
    """Round-robin over the sources until the shortest ends."""
    placed, lengths = _placed(rows, source, order_by)
    rank = {s: i for i, s in enumerate(sorted(lengths))}
    return placed.where(F.col("__k") < min(lengths.values())).withColumn(
        name, F.col("__k") * len(lengths) + _per_source(source, rank)).drop("__k")


def interleave_cycle_all(rows: DataFrame, source: str, order_by: list, name: str = "out_idx") -> DataFrame:
    """Round-robin until the longest ends; shorter sources start over.

    A row knows how often it comes round, so no join is needed. The copies of a row of a
    tiny source may be a large share of the result: they are made in blocks, and the
    blocks are spread over tasks before they expand.
    """
    placed, lengths = _placed(rows, source, order_by)
    rank = {s: i for i, s in enumerate(sorted(lengths))}
    longest = max(lengths.values())
    rounds = F.ceil((F.lit(longest) - F.col("__k")) / _per_source(source, lengths))
    blocks = placed.withColumn("__rounds", rounds).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__rounds") - 1) / COPIES_PER_ROW))))
    if longest > min(lengths.values()) * COPIES_PER_ROW:
        blocks = blocks.repartition(F.col(source), F.col("__k"), F.col("__block"))
    first = F.col("__block") * COPIES_PER_ROW
    copies = blocks.withColumn(
        "__round", F.explode(F.sequence(first, F.least(first + COPIES_PER_ROW, F.col("__rounds")) - 1)))
    step = F.col("__k") + F.col("__round") * _per_source(source, lengths)
    return copies.withColumn(name, step * len(lengths) + _per_source(source, rank)).drop(
        "__k", "__rounds", "__block", "__round")


def draw_sources(spark, probabilities: dict[int, float], steps: int, seed: int, source: str) -> DataFrame:
    """(step, source): one seeded draw per output step."""
    u = hash_uniform(seed, F.col("id"))
    edges, acc = [], 0.0
    for s, p in sorted(probabilities.items()):
        acc += p
        edges.append((s, acc))
    pick = F.lit(edges[-1][0])
    for s, edge in reversed(edges[:-1]):
        pick = F.when(u < edge, F.lit(s)).otherwise(pick)
    return spark.range(steps).select(F.col("id").alias("step"), pick.alias(source))


def interleave_prob(rows: DataFrame, source: str, order_by: list, probabilities: dict[int, float], seed: int,
                    all_exhausted: bool = False, name: str = "out_idx") -> DataFrame:
    """Draw the source of every output row; stop once the first (or last) source is used up.

    Sources that run out start over. The stop step is where a source's draw count reaches its length; the
    draw table is extended until it contains that step.
    """
    placed, lengths = _placed(rows, source, order_by)
    if set(probabilities) != set(lengths):
        raise ValueError("one probability per source is needed")
    if abs(sum(probabilities.values()) - 1.0) > 1e-9 or (all_exhausted and min(probabilities.values()) <= 0):
        raise ValueError("probabilities must be positive and add up to 1")
    needed = [n / probabilities[s] for s, n in lengths.items() if probabilities[s] > 0]
    expected = max(needed) if all_exhausted else min(needed)
    steps = math.ceil(expected + 6 * math.sqrt(expected) / min(p for p in probabilities.values() if p > 0)) + 16
    while True:
        draws = draw_sources(rows.sparkSession, probabilities, steps, seed, source)
        counted = with_group_index(draws, [source], ["step"], "__occ")
        length = _per_source(source, lengths)
        ends = [r["step"] for r in counted.where(F.col("__occ") == length - 1).select("step").collect()]
        if len(ends) == len(lengths) or (ends and not all_exhausted):
            break
        steps *= 2
    stop = max(ends) if all_exhausted else min(ends)
    plan = counted.where(F.col("step") <= stop).select(
        source, F.col("step").alias(name), (F.col("__occ") % length).alias("__k"))
    return plan.join(placed, [source, "__k"]).drop("__k")
