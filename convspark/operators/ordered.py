"""Order-dependent operators that do not need a whole key in one task.

A window over ``PARTITION BY chat_id`` puts a chat into one task, however large it is. Here every key is cut
into slices of its order column (``slice_on div width``). Windows run inside a slice; what a slice must know
about the rows before it travels as one small summary row per slice. The second level orders summaries
only, so its size is the number of slices of a key (its time span / width), never its number of rows.
Results are exact for any width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions.text import last_items
from convspark.session import stage

SLICE = "__slice"
TIME_WIDTH = 6 * 3600
FINER_WIDTHS = (3600, 600, 60, 10, 1)
SLICE_ROWS = 5_000_000


def add_slice(df: DataFrame, slice_on: str, width: int) -> DataFrame:
    """Rows with their slice. Rows that have one keep it, so that operators in a row share one shuffle."""
    return df if SLICE in df.columns else df.withColumn(SLICE, F.floor(F.col(slice_on) / F.lit(width)))


def fitting_width(df: DataFrame, keys: Sequence[str], slice_on: str, rows: int = SLICE_ROWS) -> int:
    """The widest slice, six hours or finer, of which none holds more than ``rows`` rows (one second at the least).

    This counts two columns and looks at one number per try; the first try nearly always fits."""
    for width in (TIME_WIDTH, *FINER_WIDTHS[:-1]):
        sizes = add_slice(df.select(*keys, slice_on), slice_on, width).groupBy(*keys, SLICE).agg(F.count("*").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0]
        if largest is None or largest <= rows:
            return width
    return FINER_WIDTHS[-1]


def _names(*groups: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(name for group in groups for name in group))


def number_islands(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    order: Sequence[str],
    carry: Sequence[str],
    starts: Callable[[Column, Column], Column],
    out: str,
    width: int = TIME_WIDTH,
) -> DataFrame:
    """Number the islands of each key from 0. ``starts(previous, current)`` on structs of the ``carry``
    columns tells whether a row opens an island; the first row of a key always does.

    What slices carry is worked out from the few columns it needs."""
    part = [*keys, SLICE]
    inside = Window.partitionBy(*part).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    here = F.struct(*carry)
    sliced = add_slice(df, slice_on, width)

    def opened(rows: DataFrame) -> DataFrame:
        before = F.lag(here).over(inside)
        return rows.withColumn("__opens", F.when(before.isNull(), 0).otherwise(starts(before, here).cast("int")))

    edges = (
        opened(sliced.select(*_names(keys, order, carry, [SLICE])))
        .groupBy(*part)
        .agg(
            F.min_by(here, F.struct(*order)).alias("__first"),
            F.max_by(here, F.struct(*order)).alias("__last"),
            F.sum("__opens").alias("__inner"),
        )
    )
    before = F.lag("__last").over(across)
    edges = edges.withColumn(
        "__edge", F.when(before.isNull(), 1).otherwise(starts(before, F.col("__first")).cast("int"))
    )
    earlier = F.sum(F.col("__edge") + F.col("__inner")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    base = edges.select(*part, (F.coalesce(earlier, F.lit(0)) + F.col("__edge") - 1).alias("__base"))
    run = F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        opened(sliced)
        .withColumn("__run", run)
        .join(base, part)
        .select(*df.columns, (F.col("__base") + F.col("__run")).cast("bigint").alias(out))
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    order: Sequence[str],
    values: dict[str, Column],
    width: int = TIME_WIDTH,
) -> DataFrame:
    """Totals of integer ``values`` from the first row of the key up to and with this row, one column per name."""
    part = [*keys, SLICE]
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sliced = add_slice(df, slice_on, width).withColumns({f"__v_{n}": v.cast("bigint") for n, v in values.items()})
    sums = sliced.groupBy(*part).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    base = sums.select(
        *part, *[F.coalesce(F.sum(f"__s_{n}").over(across), F.lit(0)).alias(f"__b_{n}") for n in values]
    )
    runs = sliced.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in values})
    return runs.join(base, part).select(
        *df.columns, *[(F.col(f"__b_{n}") + F.col(f"__r_{n}")).alias(n) for n in values]
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    order: Sequence[str],
    value: Column,
    out: str,
    width: int = TIME_WIDTH,
) -> DataFrame:
    return running_totals(df, keys, slice_on, order, {out: value}, width)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    order: Sequence[str],
    n: int,
    fields: Sequence[str],
    out: str,
    reach: tuple[str, int] | None = None,
    width: int = TIME_WIDTH,
    source: DataFrame | None = None,
) -> DataFrame:
    """Array of the up to ``n`` rows before this one (oldest first) as structs of ``fields``.

    ``source`` may name a frame with the same rows that is cheaper to read than ``df`` (say, ``df`` before columns
    were added by other operators); what slices carry is then taken from there.
    ``reach=(end_column, seconds)`` states that rows which ended longer than ``seconds`` before the current
    row are not wanted across slices, so they are not carried (the caller still filters inside a slice)."""
    part = [*keys, SLICE]
    inside = Window.partitionBy(*part).orderBy(*order)
    latest = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    across = Window.partitionBy(*keys).orderBy(SLICE)
    item = F.struct(*fields)
    sliced = add_slice(df, slice_on, width)
    origin = sliced if source is None else add_slice(source, slice_on, width)
    tail = origin.select(*_names(keys, order, fields, [SLICE], [reach[0]] if reach else []))
    if reach:
        tail = tail.where(F.col(reach[0]) >= (F.col(SLICE) + 1) * width - reach[1])
    tails = (
        tail.withColumn("__rank", F.row_number().over(latest))
        .where(F.col("__rank") <= n)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("__rank")).alias("__pos"), item.alias("__item")))).alias("__tail"))
        .select(*part, F.transform("__tail", lambda t: t["__item"]).alias("__tail"))
    )
    # every slice with rows takes part in the second level, also one whose own tail is empty
    slices = origin.select(*part).distinct().join(tails, part, "left")
    earlier = F.collect_list("__tail").over(across.rowsBetween(-n, -1))
    carried = slices.select(*part, last_items(F.flatten(earlier), n).alias("__carried"))
    return (
        sliced.withColumn("__local", F.collect_list(item).over(inside.rowsBetween(-n, -1)))
        .join(carried, part)
        .select(*df.columns, last_items(F.concat("__carried", "__local"), n).alias(out))
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    order: Sequence[str],
    value: Column,
    out: str,
    width: int = TIME_WIDTH,
) -> DataFrame:
    """The last non-null ``value`` strictly before this row."""
    part = [*keys, SLICE]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sliced = add_slice(df, slice_on, width).withColumn("__value", value)
    ends = sliced.groupBy(*part).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__last")
    )
    carried = ends.select(*part, F.last("__last", ignorenulls=True).over(across).alias("__carried"))
    return (
        sliced.withColumn("__local", F.last("__value", ignorenulls=True).over(inside))
        .join(carried, part)
        .select(*df.columns, F.coalesce("__local", "__carried").alias(out))
    )


def rolling_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    sums: dict[str, tuple[Column, int, int]],
) -> DataFrame:
    """One row per key and second: the sum of each value over the seconds ``[ts + first, ts + last]``.

    ``sums`` maps a name to ``(value, first, last)``. Rows are added up per second first. A value then enters the
    running total of its key when the frame of a second first reaches it and leaves when it no longer does, so the
    work grows with the seconds and not with the length of the frames."""
    names = list(sums)
    seconds = df.groupBy(*keys, ts).agg(*[F.sum(sums[n][0]).cast("bigint").alias(f"__{n}") for n in names])

    def change(at: Column, name: str | None, value: Column | None) -> Column:
        deltas = [(value if n == name else F.lit(0)).cast("bigint").alias(n) for n in names]
        return F.struct(at.alias("__at"), F.lit(name is None).alias("__asks"), *deltas)

    second = F.col(ts)
    changes = [change(second, None, None)]
    for n in names:
        _, first, last = sums[n]
        changes.append(change(second - last, n, F.col(f"__{n}")))
        changes.append(change(second - first + 1, n, -F.col(f"__{n}")))
    moves = F.filter(
        F.array(*changes), lambda c: c["__asks"] | F.exists(F.array(*[c[n] for n in names]), lambda v: v != 0)
    )
    timeline = seconds.select(*keys, F.inline(moves))
    totals = running_totals(
        timeline.select(*keys, "__at", "__asks", *[F.col(n).alias(f"__d_{n}") for n in names]),
        keys,
        "__at",
        ["__at", "__asks"],
        {n: F.col(f"__d_{n}") for n in names},
    )
    return totals.where("__asks").select(*keys, F.col("__at").alias(ts), *names)


def position_in_second(keys: Sequence[str], ts: str, order: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys, ts).orderBy(*order))


def row_numbers(df: DataFrame, order: Sequence[str], out: str, parts: int | None = None) -> DataFrame:
    """Number all rows from 0 in ``order``, which must tell any two rows apart.

    Rows are dealt out by ranges of the whole order and numbered inside their range; the ranges' counts are added up, one number for
    each range. Ranges are even however the first column repeats: all rows may share one second."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number inside a range is the lower 33 bits of Spark's own row id
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stage(dealt.withColumn("__range", F.spark_partition_id()).withColumn("__place", place), "ranges")
    sizes = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())
    starts, seen = [], 0
    for range_, count in sizes:
        starts.append((range_, seen))
        seen += count
    first = spark.createDataFrame(starts, "__range int, __first long")
    return ranged.join(F.broadcast(first), "__range").select(*df.columns, (F.col("__first") + F.col("__place")).alias(out))
