"""Running sums over groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Parts that each group is cut into; the table of their sums has at most this many rows for a group.
PARTS = 1024


def with_offsets(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with a column for each item of `sums`: of the column it names, the sum over the rows of the same group that stand before.

    Rows of a group stand in the order of (a hash of `order`, `order`), which is the same for every run. A group is cut into PARTS parts
    by that hash: each part is summed alone, and the parts' sums, at most PARTS rows a group, are summed in turn. Rows that agree in all
    of `order` stand in any order among themselves. `group` must hold no null.
    """
    parts = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    bases = whole.select(*group, "_part", *[F.coalesce(F.sum(f"_sum_{k}").over(across), F.lit(0)).alias(f"_base_{k}") for k in sums])
    placed = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()])
    return placed.join(bases, [*group, "_part"]).select(*df.columns, *[(F.col(f"_base_{k}") + F.col(f"_in_{k}")).cast("long").alias(k) for k in sums])


def _parted(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df as a table range-partitioned in `order`, with the number of its part."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parted")


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with a column for each item of `sums`: of the column it names, the sum over all rows that stand before in `order`, whose values are distinct.

    Parts of a range sort are summed alone, and the parts' sums, a row a part, in turn.
    """
    parts = _parted(df, order)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    bases = whole.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(across), F.lit(0)).alias(f"_base_{k}") for k in sums])
    placed = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()])
    return placed.join(bases, "_part").select(*df.columns, *[(F.col(f"_base_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with `out`: the place of each row in `order`, whose values are distinct, from 0."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}).drop("_one")
