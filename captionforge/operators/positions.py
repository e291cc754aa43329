"""Row positions, and the operators defined by them.

A DataFrame has no order, so every positional operator takes ``order_by``, a list of columns; a
plain name sorts ascending, nulls first. Rows with equal keys may come in any order, but each has a
position of its own, so counts are exact whatever the keys. Positions come from one distributed
sort: range partitions hold consecutive slices, so position = rows in earlier slices + offset
inside the slice. No slice depends on the number of distinct groups or keys, so a group or key
holding a third of all rows is spread over as many tasks as any other rows.

Where only a few positions matter (slices, splits, shards) nothing is sorted: the key at a position is
selected by narrowing an interval of keys, and rows are labelled where they are by comparison with it.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from captionforge.session import materialize

_SLICE, _OFFSET, _BASE, _TIE, _ROW = "__slice", "__offset", "__base", "__tie", "__row"
_OFFSET_MASK = (1 << 33) - 1


def _columns(names: list) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _sorted_slices(df: DataFrame, order: list[Column]) -> DataFrame:
    # Slice numbers are stored with the rows: a re-executed sort may cut its ranges
    # elsewhere, a written table cannot.
    # A row number breaks ties, so that equal keys too can be cut into ranges.
    placed = df.withColumn(_ROW, F.monotonically_increasing_id()).sort(*order, _ROW).drop(_ROW)
    return _with_slots(placed, "slices")


def _with_slots(df: DataFrame, label: str) -> DataFrame:
    """The written rows with the number of their partition and their place in it."""
    slot = F.monotonically_increasing_id()
    return materialize(df.withColumns({_SLICE: F.shiftright(slot, 33), _OFFSET: slot.bitwiseAND(F.lit(_OFFSET_MASK))}), label)


def with_row_index(df: DataFrame, order_by: list, name: str = "row_idx") -> DataFrame:
    """Append the dense 0-based position of each row in ``order_by`` order.

    All columns of ``df`` are sorted and written once: number the key columns and join wide ones
    afterwards where few rows need them.
    """
    slices = _sorted_slices(df, _columns(order_by))
    # One row per slice, so the unpartitioned window sees at most as many rows as the
    # sort had partitions.
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        slices.groupBy(_SLICE)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(_SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_BASE))
    )
    return (
        slices.join(materialize(bases, "bases"), _SLICE)
        .withColumn(name, F.col(_BASE) + F.col(_OFFSET))
        .drop(_SLICE, _OFFSET, _BASE)
    )


def with_group_index(df: DataFrame, group_by: list[str], order_by: list, name: str = "pos") -> DataFrame:
    """Append the dense 0-based position of each row inside its group.

    Unlike ``row_number`` over ``partitionBy(group)`` no task holds a whole group: a group
    spans consecutive slices, and its position is the rows it has in earlier slices plus
    the offset from where it starts in this one. Null is a group of its own.
    """
    slices = _sorted_slices(df, _columns([*group_by, *order_by]))
    earlier = Window.partitionBy(*group_by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (slice, group) run: at most slices + groups rows.
    runs = (
        slices.groupBy(_SLICE, *group_by)
        .agg(F.min(_OFFSET).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn(_BASE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first"))
        .drop("__first", "__n")
    )
    runs = materialize(runs, "runs").select(
        F.col(_SLICE).alias("__run_slice"), *[F.col(g).alias(f"__run_{g}") for g in group_by], _BASE
    )
    same = F.col(_SLICE) == F.col("__run_slice")
    for g in group_by:
        same = same & F.col(g).eqNullSafe(F.col(f"__run_{g}"))
    out = slices.join(runs, same).withColumn(name, F.col(_BASE) + F.col(_OFFSET))
    return out.drop(_SLICE, _OFFSET, _BASE, "__run_slice", *[f"__run_{g}" for g in group_by])


class Border(NamedTuple):
    """The sort keys at a position, the first position with these keys, and how many rows have them."""

    keys: Row
    first: int
    rows: int


SMALL = 100_000     # rows of an interval whose keys are counted one by one
SAMPLE = 20_000     # keys that narrow a larger interval
MAX_CUTS = 256      # borders that a row is compared with


def _sorts_after(df: DataFrame, order_by: list[str], row: Row | None) -> Column:
    """True for rows that sort after ``row``; all rows do when it is None (before the start)."""
    if row is None:
        return F.lit(True)
    values = [F.lit(row[c]).cast(df.schema[c].dataType) for c in order_by]
    if len(order_by) == 1:
        return F.col(order_by[0]).isNotNull() if row[order_by[0]] is None else F.col(order_by[0]) > values[0]
    whole = F.struct(*order_by) > F.struct(*[v.alias(c) for c, v in zip(order_by, values)])
    # the implied condition on the first key is one the file scan can use
    return whole if row[order_by[0]] is None else (F.col(order_by[0]) >= values[0]) & whole


class _Interval(NamedTuple):
    """Keys between two others (both left out), the position of the first of them, and their number."""

    low: Row | None
    high: Row | None
    first: int
    rows: int


def _select_exactly(keys: DataFrame, order_by: list[str], part: _Interval, wanted: list[int]) -> dict[int, Border]:
    """The borders in an interval of at most ``SMALL`` rows."""
    counted = keys.groupBy(*order_by).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = F.lit(False)
    for p in wanted:
        held = held | ((F.col("__upto") > p - part.first) & (F.col("__upto") - F.col("__n") <= p - part.first))
    out = {}
    for r in counted.withColumn("__upto", upto).where(held).collect():
        first = part.first + r["__upto"] - r["__n"]
        row = Row(*order_by)(*[r[c] for c in order_by])
        out.update({p: Border(row, first, r["__n"]) for p in wanted if first <= p < first + r["__n"]})
    return out


def _narrow(keys: DataFrame, order_by: list[str], part: _Interval, wanted: list[int], seed: int) -> tuple[dict[int, Border], dict[_Interval, list[int]]]:
    """Borders that are sampled keys, and a far smaller interval for each other position.

    A sample tells about where a position is; one pass counts the rows around it exactly.
    """
    sampled = keys.sample(min(1.0, SAMPLE / part.rows), seed).groupBy(*order_by).agg(F.count(F.lit(1)).alias("__n"))
    rows = sampled.orderBy(*order_by).collect()
    if not rows:
        return {}, {part: wanted}
    total, upto = sum(r["__n"] for r in rows), []
    for r in rows:
        upto.append((upto[-1] if upto else 0) + r["__n"])
    margin = 2 / SAMPLE ** 0.5  # four standard deviations
    plain = [Row(*order_by)(*[r[c] for c in order_by]) for r in rows]
    near = {}
    for p in wanted:
        share = (p - part.first) / part.rows
        near[p] = tuple(plain[min(bisect_right(upto, max(0.0, share + side) * total), len(rows) - 1)] for side in (-margin, margin))
    pivots = list(dict.fromkeys(k for pair in near.values() for k in pair))
    counts = keys.agg(*[f for i, k in enumerate(pivots) for f in (
        F.count(F.when(sorts_before(keys, order_by, k), 1)).alias(f"before{i}"), F.count(F.when(_same_keys(keys, order_by, k), 1)).alias(f"same{i}"))]).first()
    place = {k: (part.first + counts[f"before{i}"], counts[f"same{i}"]) for i, k in enumerate(pivots)}
    found: dict[int, Border] = {}
    left: dict[_Interval, list[int]] = {}
    for p, (low, high) in near.items():
        (at_low, same_low), (at_high, same_high) = place[low], place[high]
        if p < at_low:
            inside = _Interval(part.low, low, part.first, at_low - part.first)
        elif p < at_low + same_low:
            found[p] = Border(low, at_low, same_low)
            continue
        elif p < at_high:
            inside = _Interval(low, high, at_low + same_low, at_high - at_low - same_low)
        elif p < at_high + same_high:
            found[p] = Border(high, at_high, same_high)
            continue
        else:
            inside = _Interval(high, part.high, at_high + same_high, part.first + part.rows - at_high - same_high)
        left.setdefault(inside, []).append(p)
    return found, left


def keys_at(df: DataFrame, order_by: list[str], positions) -> tuple[int, dict[int, Border]]:
    """Row count, and the border at each of a few positions (a list, or a function of the count).

    Only the key columns are read, and nothing is sorted but a sample and an interval of ``SMALL`` rows: each pass
    over the keys leaves about a thirtieth of them. A key of very many rows is one row of a count.
    """
    keys = df.select(*order_by)
    total = keys.count()
    wanted = sorted({p for p in (positions(total) if callable(positions) else positions) if 0 <= p < total}) if total else []
    found: dict[int, Border] = {}
    open_parts = {_Interval(None, None, 0, total): wanted} if wanted else {}
    seed = 0
    while open_parts:
        further: dict[_Interval, list[int]] = {}
        for part, inside in open_parts.items():
            held = keys.where(_sorts_after(keys, order_by, part.low) & sorts_before(keys, order_by, part.high))
            if part.rows <= SMALL:
                found.update(_select_exactly(held, order_by, part, inside))
            else:
                seed += 1
                more, left = _narrow(held, order_by, part, inside, seed)
                found.update(more)
                for interval, own in left.items():
                    further[interval] = further.get(interval, []) + own
        open_parts = further
    return total, found


def _same_keys(df: DataFrame, order_by: list[str], row: Row) -> Column:
    same = F.lit(True)
    for c in order_by:
        same = same & F.col(c).eqNullSafe(F.lit(row[c]).cast(df.schema[c].dataType))
    return same


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*plain)


def _tie_index(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Number the rows of each group from 0, in any order, without bringing a group together."""
    placed = _with_slots(rows, "ties")
    earlier = Window.partitionBy(group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(group, _SLICE).agg(F.count(F.lit(1)).alias("__n")).select(
        group, _SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_BASE))
    inside = F.row_number().over(Window.partitionBy(group, _SLICE).orderBy(_OFFSET)) - 1
    return placed.withColumn(name, inside).join(materialize(bases, "bases"), [group, _SLICE]).withColumn(
        name, F.col(name) + F.col(_BASE)).drop(_SLICE, _OFFSET, _BASE)


def with_part(df: DataFrame, order_by: list[str], cuts, name: str, find=keys_at) -> tuple[DataFrame, int, dict[int, Border]]:
    """Append how many of ``cuts(total)`` lie at or before each row's position; also return the row count and the borders.

    Rows are labelled in place by comparison with the keys at the cuts, and only key columns are read to find these.
    Where a cut falls between rows with the same keys, a hash of all columns tells these apart, and
    rows that are repeated exactly are numbered.
    """
    total, borders = find(df, order_by, lambda n: [c for c in cuts(n) if 0 < c < n])
    if not total:
        return df.withColumn(name, F.lit(0)), 0, {}
    everywhere = sum(c <= 0 for c in cuts(total))
    inside = sorted(c for c in cuts(total) if 0 < c < total)
    split: dict[int, list[int]] = {}  # first position of a key -> cuts between its rows
    for c in inside:
        if borders[c].first < c:
            split.setdefault(borders[c].first, []).append(c)
    # cuts at or before each tie, for rows of a split key; the same for rows repeated exactly
    tie_part, repeated = {}, {}
    for first, own in split.items():
        tied = df.where(_same_keys(df, order_by, borders[own[0]].keys)).select(_row_hash(df).alias(_TIE))
        _, hashes = keys_at(tied, [_TIE], [c - first for c in own])
        part = F.lit(0)
        for c in own:
            h = hashes[c - first]
            part = part + F.when(F.col(_TIE) < h.keys[_TIE], 0).otherwise(1)
            if h.first < c - first:
                repeated[first, h.keys[_TIE]] = first + h.first
        tie_part[first] = part
    part = F.lit(everywhere)
    for c in inside:
        if c not in split.get(borders[c].first, ()):
            part = part + F.when(sorts_before(df, order_by, borders[c].keys), 0).otherwise(1)
    for first, own in split.items():
        keys = borders[own[0]].keys
        part = part + F.when(sorts_before(df, order_by, keys), 0).when(_same_keys(df, order_by, keys), tie_part[first]).otherwise(len(own))
    if not split:
        return df.withColumn(name, part), total, borders
    some_key = F.lit(False)
    for own in split.values():
        some_key = some_key | _same_keys(df, order_by, borders[own[0]].keys)
    tied = df.withColumn(_TIE, F.when(some_key, _row_hash(df)))
    if not repeated:
        return tied.withColumn(name, part).drop(_TIE), total, borders
    group = F.lit(None).cast("long")
    for (first, h), at in repeated.items():
        group = F.when(_same_keys(df, order_by, borders[split[first][0]].keys) & (F.col(_TIE) == h), F.lit(at).cast("long")).otherwise(group)
    marked = tied.withColumn("__first", group)
    clear = marked.where("__first is null").withColumn(name, part)
    numbered = _tie_index(marked.where("__first is not null"), "__first", "__number")
    at = F.col("__first") + F.col("__number")
    exact = F.lit(everywhere)
    for c in inside:
        exact = exact + F.when(at >= c, 1).otherwise(0)
    out = clear.select(*df.columns, name).union(numbered.withColumn(name, exact).select(*df.columns, name))
    return out, total, borders


def sorts_before(df: DataFrame, order_by: list[str], row: Row | None) -> Column:
    """True for rows that sort before ``row``; all rows do when it is None (past the end).

    The condition on the first key alone is implied, and is one the file scan can use.
    """
    if row is None:
        return F.lit(True)
    values = [F.lit(row[c]).cast(df.schema[c].dataType) for c in order_by]
    first = F.col(order_by[0])
    if len(order_by) == 1:
        return first.isNull() | (first < values[0]) if row[order_by[0]] is not None else F.lit(False)
    whole = F.struct(*order_by) < F.struct(*[v.alias(c) for c, v in zip(order_by, values)])
    return whole if row[order_by[0]] is None else (first.isNull() | (first <= values[0])) & whole


def _slice_rows(df: DataFrame, order_by: list, bounds) -> DataFrame:
    """Rows at positions [start, stop), where ``bounds(total)`` gives the two."""
    if all(isinstance(c, str) for c in order_by):
        def cuts(total: int) -> list[int]:
            start, stop = bounds(total)
            return [start, max(start, stop)]

        parted, total, borders = with_part(df, order_by, cuts, "__part")
        if not total:
            return df.limit(0)
        # implied conditions on the first key, which a file scan can use
        first, (start, stop) = order_by[0], cuts(total)
        for cut, side in ((start, F.col(first).__ge__), (stop, F.col(first).__le__)):
            value = borders[cut].keys[first] if cut in borders else None
            if value is not None:
                held = side(F.lit(value).cast(df.schema[first].dataType))
                parted = parted.where(held if cut == start else F.col(first).isNull() | held)
        return parted.where("__part = 1").drop("__part")
    indexed = with_row_index(df, order_by, "__idx")
    start, stop = bounds(indexed.count())
    return indexed.where((F.col("__idx") >= start) & (F.col("__idx") < stop)).drop("__idx")


def shard_of(row_idx: Column, total: Column | int, shards: int) -> Column:
    """Contiguous shard number: the first ``total % shards`` shards get one row more."""
    total = total if isinstance(total, Column) else F.lit(total)
    div = F.floor(total / F.lit(shards))
    mod = total % F.lit(shards)
    wide = mod * (div + 1)
    # with fewer rows than shards div is 0 and every row is in the wide part
    return F.when(row_idx < wide, F.floor(row_idx / (div + 1))).otherwise(
        mod + F.floor((row_idx - wide) / F.greatest(div, F.lit(1)))
    ).cast("long")


def shard_contiguous(df: DataFrame, order_by: list, shards: int, name: str = "shard") -> DataFrame:
    """Append the number of the contiguous shard of each row.

    With named keys and at most ``MAX_CUTS`` shards rows are labelled in place; else they are sorted and written once.
    """
    if shards <= MAX_CUTS and all(isinstance(c, str) for c in order_by):
        starts = lambda total: [i * (total // shards) + min(i, total % shards) for i in range(1, shards)]
        parted, _, _ = with_part(df, order_by, starts, name)
        return parted.withColumn(name, F.col(name).cast("long"))
    indexed = with_row_index(df, order_by, "__idx")
    total = indexed.count()
    return indexed.withColumn(name, shard_of(F.col("__idx"), total, shards)).drop("__idx")


def shard_strided(df: DataFrame, order_by: list, shards: int, name: str = "shard") -> DataFrame:
    return with_row_index(df, order_by, "__idx").withColumn(name, F.col("__idx") % shards).drop("__idx")


def shard(df: DataFrame, order_by: list, num_shards: int, index: int, contiguous: bool = True) -> DataFrame:
    """The rows of one shard."""
    if not 0 <= index < num_shards:
        raise ValueError(f"there is no shard {index} among {num_shards}")
    if not contiguous:
        return shard_strided(df, order_by, num_shards, "__shard").where(F.col("__shard") == index).drop("__shard")

    def bounds(total: int) -> tuple[int, int]:
        # shard i has a row for each of i, i + shards, i + 2 * shards, ... below total
        size = lambda i: len(range(i, total, num_shards))
        start = sum(map(size, range(index)))
        return start, start + size(index)

    return _slice_rows(df, order_by, bounds)


def split_by_node(df: DataFrame, order_by: list, rank: int, world_size: int) -> DataFrame:
    return shard(df, order_by, world_size, rank)


def select_indices(df: DataFrame, order_by: list, indices: DataFrame, index_col: str, pos_col: str) -> DataFrame:
    """Rows at the given positions, in list order; duplicates repeat a row.

    ``indices`` holds one row per wanted position. Negative positions count from the end;
    a position outside [-n, n) raises.
    """
    indexed = with_row_index(df, order_by, "__idx")
    total = indexed.count()
    wanted = F.col(index_col)
    checked = F.when((wanted >= total) | (wanted < -total), F.raise_error(
        F.concat(F.lit("index out of range: "), wanted.cast("string"))).cast("long")
    ).when(wanted < 0, wanted + total).otherwise(wanted)
    picks = indices.select(F.col(pos_col), checked.alias("__idx"))
    return picks.join(indexed, "__idx").drop("__idx")


def skip(df: DataFrame, order_by: list, n: int) -> DataFrame:
    return _slice_rows(df, order_by, lambda total: (min(n, total), total))


def take(df: DataFrame, order_by: list, n: int) -> DataFrame:
    """First ``n`` rows, by position."""
    return _slice_rows(df, order_by, lambda total: (0, min(n, total)))


def getitem(df: DataFrame, order_by: list, key) -> DataFrame:
    """``ds[i]``, ``ds[a:b:c]``, ``ds[[...]]`` or ``ds["column"]``."""
    if isinstance(key, str):
        if key not in df.columns:
            raise KeyError(key)
        return df.select(key)
    if isinstance(key, slice) and key.step in (None, 1):
        return _slice_rows(df, order_by, lambda total: key.indices(total)[:2])
    if isinstance(key, slice):
        # the positions are an arithmetic sequence between two ends; a negative step takes them from the last to the first
        indexed = with_row_index(df, order_by, "__idx")
        places = range(indexed.count())[key]
        if not places:
            return df.limit(0)
        low, high, step = min(places), max(places), abs(places.step)
        idx = F.col("__idx")
        picked = indexed.where((idx >= low) & (idx <= high) & ((idx - low) % step == 0))
        return (picked.orderBy(idx.desc()) if places.step < 0 else picked).drop("__idx")
    wanted = [key] if isinstance(key, int) else list(key)
    spark = df.sparkSession
    picks = spark.createDataFrame(list(enumerate(wanted)), "__pos long, __want long")
    return select_indices(df, order_by, picks, "__want", "__pos").orderBy("__pos").drop("__pos")


def batch(df: DataFrame, order_by: list, size: int, drop_last: bool = False) -> DataFrame:
    """``size`` consecutive rows become one row of arrays; a group never exceeds ``size``."""
    columns = df.columns
    indexed = with_row_index(df, order_by, "__idx")
    rows = F.array_sort(F.collect_list(F.struct("__idx", *columns)))
    grouped = indexed.groupBy(F.floor(F.col("__idx") / size).alias("batch_id")).agg(rows.alias("__rows"))
    if drop_last:
        grouped = grouped.where(F.size("__rows") == size)
    return grouped.select("batch_id", *[F.col("__rows")[c].alias(c) for c in columns])


def sub_batch(pos_in_batch: Column, piece_size: int) -> Column:
    """Which piece of a loader batch a row belongs to when it is split into equal pieces."""
    return F.floor(pos_in_batch / piece_size)


def chunk_ranges(spark, total: int, size: int, lose_last_row: bool = False) -> DataFrame:
    """Half-open ranges covering ``total`` rows.

    ``lose_last_row`` reproduces the original planner, whose final range stops one short.
    """
    end = F.least(F.col("start") + size, F.lit(total - 1 if lose_last_row else total))
    chunks = -(-total // size)
    return spark.range(chunks).select(
        F.col("id").alias("chunk_id"), (F.col("id") * size).alias("start")
    ).withColumn("stop", end)


def flatten_indices(df: DataFrame) -> DataFrame:
    """Materialise a lazily described selection so later readers do not recompute it."""
    return materialize(df, "flat")


def rows_per_file(row_idx: Column, rows: int) -> Column:
    """File number for a fixed count of rows per file."""
    return F.floor(row_idx / rows)
