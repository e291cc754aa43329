"""User functions over rows and batches, and result reuse."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.utils import AnalysisException

from captionforge.operators.positions import with_row_index


def _kept(schema: T.StructType, remove: list[str]) -> list[T.StructField]:
    return [f for f in schema if f.name not in remove]


def map_columns(df: DataFrame, updates: dict[str, Column], remove_columns: list[str] = ()) -> DataFrame:
    """Column-expression form of a row map: removed columns go first, then the updates apply."""
    kept = [F.col(c) for c in df.columns if c not in remove_columns and c not in updates]
    return df.select(*kept, *[v.alias(k) for k, v in updates.items()])


# Whole numbers and booleans with nulls keep their values in these; without them pandas makes them floats.
_NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
             pa.bool_(): pd.BooleanDtype()}


def to_frame(batch: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """A pandas frame with exact values: plain numpy types where a column has no null."""
    columns = {}
    for name, column in zip(batch.schema.names, batch.columns):
        columns[name] = column.to_pandas(types_mapper=_NULLABLE.get if column.null_count else None)
    return pd.DataFrame(columns, columns=batch.schema.names)


def from_frame(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)


def _arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict | None], new_schema: str | T.StructType = "",
             remove_columns: list[str] = (), input_columns: list[str] | None = None) -> DataFrame:
    """``fn(row dict)`` returns the columns to update, or None to leave rows as they are.

    Rows cross to Python as Arrow batches; columns that the function neither reads nor sets come back as
    they went. ``new_schema`` declares the columns the function sets.
    """
    declared = T.StructType.fromDDL(new_schema) if isinstance(new_schema, str) and new_schema else new_schema
    updated = {f.name: f for f in declared} if declared else {}
    fields = [updated.get(f.name, f) for f in _kept(df.schema, remove_columns)]
    fields += [f for n, f in updated.items() if n not in {x.name for x in fields}]
    schema = _arrow_schema(T.StructType(fields))
    old = set(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = (batch.select(input_columns) if input_columns else batch).to_pylist()
            results = [fn(row) or {} for row in given]
            columns = []
            for field in schema:
                at = batch.schema.get_field_index(field.name)
                if field.name not in updated:
                    columns.append(batch.column(at).cast(field.type))
                    continue
                was = batch.column(at).to_pylist() if field.name in old else [None] * batch.num_rows
                columns.append(pa.array([r.get(field.name, w) for r, w in zip(results, was)], field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, T.StructType(fields))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """``fn`` on every Arrow batch as a pandas frame; it may return more or fewer rows.

    Batch borders follow Spark's record limit. Use ``map_exact_batches`` where they matter.
    """
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from_frame(fn(to_frame(batch)), target)

    return df.mapInArrow(run, schema)


def map_exact_batches(df: DataFrame, order_by: list, fn: Callable[[pd.DataFrame], pd.DataFrame],
                      schema: str | T.StructType, batch_size: int = 1000, drop_last_batch: bool = False) -> DataFrame:
    """``fn`` on batches of exactly ``batch_size`` consecutive rows."""
    columns = df.columns
    indexed = with_row_index(df, order_by, "__idx")
    target = _arrow_schema(schema)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__idx").select(columns)
        if drop_last_batch and rows.num_rows < batch_size:
            rows = rows.slice(0, 0)
        return pa.Table.from_batches([from_frame(fn(to_frame(rows)), target)])

    return indexed.groupBy(F.floor(F.col("__idx") / batch_size)).applyInArrow(run, schema)


def map_with_context(df: DataFrame, order_by: list, fn: Callable[..., pd.DataFrame], schema: str | T.StructType,
                     input_columns: list[str] | None = None, with_rank: bool = False, **fn_kwargs) -> DataFrame:
    """``fn(batch, indices[, rank], **kwargs)``: batch map that also gets row positions and the task's rank."""
    indexed = with_row_index(df, order_by, "__idx")
    chosen = list(input_columns or df.columns)
    narrow = indexed.select(*chosen, "__idx", F.spark_partition_id().alias("__rank"))
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = to_frame(batch)
            args = [frame[chosen], frame["__idx"]]
            if with_rank:
                args.append(int(frame["__rank"].iloc[0]) if len(frame) else 0)
            yield from_frame(fn(*args, **fn_kwargs), target)

    return narrow.mapInArrow(run, schema)


HELD_STATES = 50_000    # states of user aggregates that a task holds
MERGED_TASKS = 64       # tasks whose states are merged at once


def aggregate_state(df: DataFrame, by: list[str], update: Callable, merge: Callable, finish: Callable, result: str) -> DataFrame:
    """A user aggregate per group: (by..., the columns of ``result``).

    ``update(state, rows)`` takes the state so far (None at first) and a pandas frame of a group's rows, ``merge(a, b)`` joins two
    states in any order, ``finish(state)`` gives the values of ``result`` as a tuple. A state is anything that can be
    pickled. Tasks fill states where rows are read; only states are exchanged, and merged in two levels, so a
    group of any size passes through no single task. Null is a group of its own.
    """
    keys = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]
    held_schema, done_schema = ", ".join([*keys, "__state binary", "__task int"]), ", ".join([*keys, result])
    held_target, done_target = _arrow_schema(held_schema), _arrow_schema(done_schema)
    plain = lambda value: None if pd.api.types.is_scalar(value) and pd.isna(value) else value

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict = {}
        task, target = TaskContext.get().partitionId(), held_target

        def rows() -> pa.RecordBatch:
            states = [pickle.dumps(x) for x in held.values()]
            columns = [pa.array([k[i] for k in held], target.field(i).type) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.binary()), pa.array([task] * len(held), pa.int32())], schema=target)

        for batch in batches:
            frame = to_frame(batch)
            for key, own in frame.groupby(by, sort=False, dropna=False):
                key = tuple(map(plain, key if isinstance(key, tuple) else (key,)))
                held[key] = update(held.get(key), own)
            if len(held) > HELD_STATES:
                yield rows()
                held.clear()
        yield rows()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, state) of rows that lie next to each other by key."""
        key, state = None, None
        for batch in batches:
            names = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*by, "__state"]]
            for *own, packed in zip(*names):
                if key == own:
                    state = merge(state, pickle.loads(packed))
                else:
                    if key is not None:
                        yield key, state
                    key, state = own, pickle.loads(packed)
        if key is not None:
            yield key, state

    def merge_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state in join(batches):
            row = zip([*key, pickle.dumps(state), 0], held_target)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in row], schema=held_target)

    def merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state in join(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*key, *finish(state)], done_target)], schema=done_target)

    states = df.mapInArrow(fill, held_schema).withColumn("__part", F.floor(F.col("__task") / MERGED_TASKS))
    some = states.repartition(*by, "__part").sortWithinPartitions(*by).mapInArrow(merge_some, held_schema)
    return some.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge_all, done_schema)


def row_function(fn: Callable, return_type: str) -> Callable:
    """A per-row Python callable as a column function, moved in Arrow batches."""
    return F.udf(fn, returnType=return_type, useArrow=True)


def lazy_transform(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A chain of frame functions for ``df.transform``; nothing runs until the result is used."""

    def apply(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return apply


def cached_map(df: DataFrame, step: Callable[[DataFrame], DataFrame], cache_dir: str, version: str) -> DataFrame:
    """Result of ``step(df)``, written under a caller-given version and reused while it exists."""
    path = f"{cache_dir.rstrip('/')}/{version}"
    spark = df.sparkSession
    try:
        # a finished write leaves a readable table; a failed one left no committed files
        return spark.read.parquet(path)
    except AnalysisException:
        step(df).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
