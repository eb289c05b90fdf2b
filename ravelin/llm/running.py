"""Running totals over any number of rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.scratch import table


def running_totals(rows: DataFrame, by: list[str], order: list[Column | str], values: list[str], keep_slice: bool = False, nulls: bool = True, sliced: bool = False) -> DataFrame:
    """rows with before_{value}: the sum of value over the rows of the same `by` that come earlier in `order`.

    Rows are range-partitioned by (by, order), so that a group with most of
    the rows lies in many slices, and kept as a table: a slice then stays the
    same for every later reader. Each slice adds up its own groups; a window
    over those few sums (one for each slice and group in it) gives what every
    slice starts from. Nulls in `by` are a group of their own; null values
    count as 0. keep_slice: the number of a row's slice comes too, as `slice`.
    nulls=False: there are none in `by`, so plain joins do. sliced: rows are in
    slices already, named by their column slice, whose order within a group
    agrees with `order`; they are dealt no second time.
    """
    slices = rows if sliced else rows.repartitionByRange(*by, *order).withColumn("slice", F.spark_partition_id())
    slices = table(slices, "slices")
    sums = slices.groupBy("slice", *by).agg(*(F.sum(v).alias(f"sum_{v}") for v in values))
    earlier = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("slice").alias("slice_"),
        *(F.col(b).alias(f"{b}_") for b in by),
        *(F.coalesce(F.sum(f"sum_{v}").over(earlier), F.lit(0)).alias(f"start_{v}") for v in values),
    )
    if nulls:
        starts = table(starts, "starts")
    within = Window.partitionBy("slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = slices.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"in_{v}") for v in values))
    same = F.col("slice") == F.col("slice_")
    for b in by:
        same = same & (F.col(b).eqNullSafe(F.col(f"{b}_")) if nulls else F.col(b) == F.col(f"{b}_"))
    out = local.join(starts, same)
    return out.select(
        *(["slice"] if keep_slice else []), *(c for c in rows.columns if c != "slice" or not sliced), *((F.col(f"start_{v}") + F.col(f"in_{v}")).alias(f"before_{v}") for v in values)
    )
