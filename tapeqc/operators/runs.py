"""Runs of neighbouring rows, of keys of any size: a segmented scan.

An asset's rows are cut into blocks of their order. Each block is sorted and cut into runs alone, as (open prefix, closed runs, open suffix): only
its first and its last run can go on in other blocks. These alone, two a block at most, meet by asset and are joined where they go on; runs
within a block are done. So no task sorts an asset, however long, and what an asset's last task holds is a few rows of every 8192.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: The part of the order (frames) that a block covers.
WIDTH = 8192


def runs(rows: DataFrame, keys: list[str], order: str, state: Column, totals: dict[str, tuple[Column, Callable[[Column], Column]]], goes_on: Callable[[Column, Column], Column] | None = None, width: int = WIDTH) -> DataFrame:
    """keys, first, last (of the order) and totals: a row for each run of rows of the same keys.

    totals: a run's aggregate over rows, and the aggregate that joins those of its parts. A row goes on with the run of the row before if
    `goes_on` of the two says so, each a struct of first, last, head and tail: where a part begins and ends, and the state of its first and its
    last row; by default if the states are equal. Null (as for the first row) starts a run. `order` is a number, distinct within the keys.
    """
    goes_on = goes_on or (lambda before, now: before["tail"].eqNullSafe(now["head"]))
    part = lambda first, last, head, tail: F.struct(first.alias("first"), last.alias("last"), head.alias("head"), tail.alias("tail"))
    place = F.col(order)
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    own = rows.withColumns({"_block": F.floor(place / width), "_state": state})
    at, was, now = F.lag(order).over(w), F.lag("_state").over(w), F.col("_state")
    same = (F.row_number().over(w) > 1) & goes_on(part(at, at, was, was), part(place, place, now, now))
    own = own.withColumns({"_new": ~F.coalesce(same, F.lit(False)), "_end": F.lead(F.lit(True)).over(w).isNull()})
    own = own.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Flat columns: rows stay narrow, and what one sort has ordered is not sorted again.
    ends = {"_part_first": F.min(order), "_part_last": F.max(order), "_part_head": F.min_by("_state", order), "_part_tail": F.max_by("_state", order)}
    parts = own.groupBy(*keys, "_block", "_run").agg(*[x.alias(k) for k, x in ends.items()], F.bool_or("_end").alias("_right"), *[first.alias(k) for k, (first, _) in totals.items()])
    parts = parts.withColumn("_left", F.col("_run") == 1)
    # Runs that are closed stay with their block; open ones meet by key.
    parts = parts.withColumn("_closed", F.when(~F.col("_left") & ~F.col("_right"), F.col("_block")))
    w = Window.partitionBy(*keys, "_closed").orderBy("_part_first")
    before = part(*[F.lag(k).over(w) for k in ends])
    joined = F.lag("_right").over(w) & F.col("_left") & goes_on(before, part(*map(F.col, ends)))
    parts = parts.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int"))
    parts = parts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy(*keys, "_closed", "_run").agg(F.min("_part_first").alias("first"), F.max("_part_last").alias("last"), *[merge(F.col(k)).alias(k) for k, (_, merge) in totals.items()])
    return out.drop("_closed", "_run")


def near_rows(rows: DataFrame, keys: list[str], order: str, columns: dict[str, Callable[[WindowSpec], Column]], reach: int, width: int = WIDTH) -> DataFrame:
    """rows with `columns`, each a function of a window ordered by `order` that looks at most `reach` rows back and ahead.

    Blocks are sorted alone, which is right for all rows but those within `reach` of a block's ends; of each block, the rows within twice that of its ends
    are sorted by key once more, and are right there for those. `order` is a number, distinct within the keys.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    own = rows.withColumn("_block", F.floor(F.col(order) / width))
    own = own.withColumns({f"_in_{k}": f(w) for k, f in columns.items()} | {"_row": F.row_number().over(w), "_rows": F.count("*").over(Window.partitionBy(*keys, "_block"))})
    within = lambda n: (F.col("_row") > n) & (F.col("_row") <= F.col("_rows") - n)
    own = own.withColumn("_block", F.when(within(2 * reach), F.col("_block")))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    return own.select(*rows.columns, *[F.when(within(reach), F.col(f"_in_{k}")).otherwise(f(w)).alias(k) for k, f in columns.items()])
