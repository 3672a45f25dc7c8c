"""Groups of any size as blocks: every pair of a group's rows meets in one block pair, and no task holds a whole large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, key: str, member: str, counts: DataFrame, most: int) -> DataFrame:
    """rows with _block, _i and _j: copies of a row for each pair (i, j), i <= j, of blocks of its group that holds its own block.

    counts: `key` and `_n`, the group's rows, for the groups to keep. A group of up to `most` rows is one block. Pairs of rows of one
    block meet where i = j, others where {i, j} are their blocks. A row is copied once for each block of its group.
    """
    wide = rows.join(counts, key).withColumn("_blocks", F.ceil(F.col("_n") / most).cast("int"))
    own = wide.withColumn("_block", F.pmod(F.xxhash64(member, F.lit(5)), F.col("_blocks")).cast("int"))
    copies = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return copies.select(*rows.columns, "_block", F.least("_block", "_with").alias("_i"), F.greatest("_block", "_with").alias("_j"))
