"""Running sums and ranks whose groups may be of any size: rows are dealt by ranges of their order, and what ranges hold is added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.shared import stored


#: The bits of monotonically_increasing_id below the partition's number.
PLACE_BITS = 33


def dealt(rows: DataFrame, order: list[Column], at: str, ranges: int | None = None) -> DataFrame:
    """rows by ranges of the order, sorted and written there, with `at`: the range above PLACE_BITS, the place in it from 0 below."""
    by_range = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    return stored(by_range.withColumn(at, F.monotonically_increasing_id()))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their place from 1 in an order of all rows that leaves no ties.

    Rows move and are sorted once, as they are dealt; a place is then that in the range and what the ranges before hold.
    rows are read twice, to find the ranges and to deal them.
    """
    placed = dealt(rows, order, "at_")
    held = placed.groupBy(F.shiftright("at_", PLACE_BITS).alias("range_")).agg(F.count(F.lit(1)).alias("held_"))
    ahead = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    carried = stored(held.select("range_", F.coalesce(F.sum("held_").over(ahead), F.lit(0)).alias("before_")))
    joined = placed.withColumn("range_", F.shiftright("at_", PLACE_BITS)).join(F.broadcast(carried), "range_")
    return joined.select(*rows.columns, (F.col("at_").bitwiseAND(F.lit(2**PLACE_BITS - 1)) + 1 + F.col("before_")).alias(name))


def last(placed: DataFrame, at: str, values: dict[str, Column]) -> DataFrame:
    """Rows that `dealt` has dealt with, for each named value, the last that isn't null up to this row.

    A range is one task's, and gets what the ranges before end with.
    """
    ranged = placed.withColumn("range_", F.shiftright(at, PLACE_BITS))
    own = Window.partitionBy("range_").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranged.groupBy("range_").agg(*[F.max_by(value, F.when(value.isNotNull(), F.col(at))).alias(name) for name, value in values.items()])
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    carried = stored(ends.select("range_", *[F.last(name, ignorenulls=True).over(before).alias(f"{name}_before") for name in values]))
    joined = ranged.withColumns({name: F.last(value, ignorenulls=True).over(own) for name, value in values.items()}).join(F.broadcast(carried), "range_")
    return joined.select(*placed.columns, *[F.coalesce(name, f"{name}_before").alias(name) for name in values])


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each named sum, the sum over the rows of the same keys up to and with this one, in that order.

    Rows are dealt by ranges of (keys, order), so a group may span any number of ranges and no task gets all of it. Groups
    that span ranges get what the ranges before hold of them; as a range begins inside one group at most, those are fewer
    than ranges, which bounds the broadcast. Without keys the order is one of all rows. Order should leave no ties. rows
    are read twice, to find the ranges and to deal them, and should be stored if they are costly.
    """
    dealt = stored(rows.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))
    own = Window.partitionBy("range_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({name: F.sum(value).over(own) for name, value in sums.items()})
    held = dealt.groupBy("range_", *keys).agg(*[F.sum(value).alias(f"{name}_held") for name, value in sums.items()])
    if keys:
        held = stored(held)
        # Of each range the first group alone can have begun in a range before.
        ends = held.groupBy("range_").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"))
        spanning = ends.select(F.explode(F.array("first", "last")).alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(f"group.{k}").alias(f"{k}_") for k in keys])
        held = held.join(F.broadcast(spanning), [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left_semi")
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    carried = held.select(F.col("range_").alias("at_"), *[F.col(k).alias(f"{k}_") for k in keys], *[F.sum(f"{name}_held").over(before).alias(f"{name}_before") for name in sums])
    carried = carried.filter(F.col(f"{next(iter(sums))}_before").isNotNull())
    joined = local.join(F.broadcast(carried), [F.col("range_") == F.col("at_"), *[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]], "left")
    return joined.select(*rows.columns, *[(F.col(name) + F.coalesce(f"{name}_before", F.lit(0))).alias(name) for name in sums])
