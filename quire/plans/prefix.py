"""Skew-safe running sums: range partition, sum per slice, add the slices before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.storage import staged, width


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group up to and including this one.

    A group of any size is cut into range slices, so no task ever holds a whole hot group.  ``order`` must
    identify a row within its group; nulls sort first.  An empty input gives an empty result.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(width(spark), *[F.col(c) for c in (*group, *order)])
    cut = staged(cut.withColumn("_slice", F.spark_partition_id()), "prefix")
    per_slice = cut.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(*group, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum(value).over(upto))
    a, b = local.alias("a"), per_slice.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_slice")]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return a.join(b, cond).select("a.*", "b._before").withColumn(out, F.col("_local") + F.col("_before")).drop("_slice", "_local", "_before")


def with_previous(df: DataFrame, group: list[str], order: str, columns: list[str], out: str = "previous") -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the row before this one in its group, null for the first.

    As in ``prefix_sums`` a group is cut into range slices; a slice's first row takes the last one of the slice before.
    ``order`` must identify a row within its group.
    """
    spark = df.sparkSession
    cut = df.repartitionByRange(width(spark), *[F.col(c) for c in (*group, order)])
    cut = staged(cut.withColumn("_slice", F.spark_partition_id()), "previous")
    row = F.struct(*[F.col(c) for c in columns])
    inside = Window.partitionBy(*group, "_slice").orderBy(order)
    local = cut.withColumn("_local", F.lag(row).over(inside))
    ends = cut.groupBy(*group, "_slice").agg(F.max_by(row, F.col(order)).alias("_last"))
    carried = ends.select(*group, "_slice", F.lag("_last").over(Window.partitionBy(*group).orderBy("_slice")).alias("_carried")).filter("_carried is not null")
    a, b = local.alias("a"), carried.alias("b")
    cond = F.col("a._local").isNull() & (F.col("a._slice") == F.col("b._slice"))
    for c in group:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    # few groups reach over a slice's end, so there are few rows to carry
    return a.join(b, cond, "left").select("a.*", F.coalesce("a._local", "b._carried").alias(out)).drop("_slice", "_local")
