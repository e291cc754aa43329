"""Column selection, renaming, casting and class encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionforge.operators.positions import with_row_index


def _require(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    _require(df, names)
    return df.select(*map(_quoted, names))


def remove_columns(df: DataFrame, names: list[str]) -> DataFrame:
    _require(df, names)
    return df.drop(*names)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    _require(df, mapping)
    renamed = [mapping.get(c, c) for c in df.columns]
    if len(set(renamed)) < len(renamed):
        raise ValueError(f"renaming gives duplicate columns: {renamed}")
    return df.withColumnsRenamed(mapping)


def cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast every column; the column sets must be equal. Bad values raise (ANSI casts)."""
    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"{sorted(df.columns)} and {sorted(schema.names)} differ")
    return df.select(*[_quoted(f.name).cast(f.dataType).alias(f.name) for f in schema])


def cast_column(df: DataFrame, name: str, data_type) -> DataFrame:
    _require(df, [name])
    return df.withColumn(name, _quoted(name).cast(data_type))


def _leaves(value: Column, name: str, data_type: T.DataType):
    if not isinstance(data_type, T.StructType):
        yield value.alias(name)
        return
    for field in data_type:
        yield from _leaves(value.getField(field.name), f"{name}.{field.name}", field.dataType)


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields, at any depth, become ``parent.child`` columns in their parent's place."""
    return df.select(*[leaf for f in df.schema for leaf in _leaves(_quoted(f.name), f.name, f.dataType)])


def add_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def class_text(df: DataFrame, name: str) -> Column:
    """The value as text, spelled the way class names are (booleans as True / False)."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(_quoted(name).cast("string"))
    return _quoted(name).cast("string")


def class_encode(df: DataFrame, name: str, include_nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace a column by its class id and return the (id, name) table.

    Ids follow the sorted distinct values. Distinct values are pre-aggregated before their
    shuffle, and the name table joins back by the size Spark measures for it.
    """
    _require(df, [name])
    text = class_text(df, name)
    if include_nulls:
        text = F.coalesce(text, F.lit("None"))
    keyed = df.withColumn("__class", text)
    distinct = keyed.select("__class").where(F.col("__class").isNotNull()).distinct()
    names = with_row_index(distinct, ["__class"], "class_id").select(
        F.col("class_id").cast("int"), F.col("__class").alias("class_name")
    )
    encoded = (
        keyed.join(names, F.col("__class") == F.col("class_name"), "left")
        .withColumn(name, F.col("class_id"))
        .drop("__class", "class_id", "class_name")
    )
    return encoded.select(*map(_quoted, df.columns)), names


def align_labels(df: DataFrame, name: str, names: list[str], label2id: dict[str, int]) -> DataFrame:
    """Recode label ids to another numbering by lower-cased class name.

    ``names`` is the current id -> name list. Works on a scalar or an array column; an id
    whose name has no target raises, null stays null.
    """
    target = {k.lower(): v for k, v in label2id.items()}
    recode = F.create_map(*[
        F.lit(v) for i, n in enumerate(names) if n.lower() in target for v in (i, target[n.lower()])
    ])

    def one(x: Column) -> Column:
        return F.when(x.isNotNull(), F.coalesce(
            F.try_element_at(recode, x.cast("int")),
            F.raise_error(F.concat(F.lit("no aligned label for "), x.cast("string"))).cast("int"),
        ))

    if isinstance(df.schema[name].dataType, T.ArrayType):
        return df.withColumn(name, F.transform(_quoted(name), one))
    return df.withColumn(name, one(_quoted(name)))


def rebase_label(label: Column, class_min: int) -> Column:
    return label - class_min


def drop_pandas_index(df: DataFrame) -> DataFrame:
    return df.drop("__index_level_0__")
