"""Tables in the folder that driver and executors share, for the operators here; and a join with keys of any number of rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, shared_dir, written

__all__ = ["discard", "shared_dir", "spread_join", "written"]

#: Keys that may be called hot: those with more than one in so many of all rows, which so many keys at most can have.
HOT_KEYS = 2000


def spread_join(rows: DataFrame, small: DataFrame, key: str, n: str, least: int = 1000) -> DataFrame:
    """rows left-joined with small (`key`, distinct, and other columns that rows lack), where `n` of small is how many rows have the key; `n` itself leaves.

    Hot keys, with more than one in HOT_KEYS of these rows and over `least`, are HOT_KEYS at most: they are joined where the rows are, and
    their rows are then dealt over all tasks by their hash. The others meet in an exchange. small must be a written table.
    """
    limit = max(least, (small.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot, cold = small.where(F.col(n) > limit).drop(n), small.where(F.col(n) <= limit).drop(n)
    if hot.isEmpty():
        return rows.join(cold, key, "left").select(*rows.columns, *[c for c in cold.columns if c != key])
    others = [c for c in cold.columns if c != key]
    known = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    apart = F.when(F.col("_hot") | F.col(key).isNull(), F.xxhash64(*rows.columns)).otherwise(0)
    near = known.select(*rows.columns, "_hot", F.struct(*others).alias("_mine"), apart.alias("_apart"), F.when(F.col("_hot").isNull(), F.col(key)).alias("_key"))
    far = cold.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_apart"), F.struct(*others).alias("_theirs"))
    joined = near.join(far, ["_key", "_apart"], "left")
    mine = F.when(F.col("_hot"), F.col("_mine")).otherwise(F.col("_theirs"))
    return joined.select(*rows.columns, *[mine[c].alias(c) for c in others])
