"""Row numbers and running sums over a whole table, or over groups of any size, without putting a group into one task.

Rows are range-partitioned and sorted; numbers and sums are taken within partitions and raised by what the partitions before
hold.  A group that fills many partitions is numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tables import cut


def numbered(df: DataFrame, order: Sequence[Column | str], within: Sequence[str] = (), name: str = "rn", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``name``, the place of each row (from 1) in its group, and the running sums ``sums`` (new column -> summed column), its own row included."""
    sums = sums or {}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c) for c in within], *order]
    # one shuffle: a sorted partition's rows get their places as they are written
    parts = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_m", 33))
    sizes = parts.groupBy(*within, "_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_s_{c}") for c, s in sums.items()])
    before = W.partitionBy(*within).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offset = sizes.select(
        *[F.col(c).alias(f"_g_{c}") for c in within], F.col("_p").alias("_q"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums]
    )
    upto = W.partitionBy("_p", *within).orderBy("_m").rowsBetween(W.unboundedPreceding, 0)
    own = parts.withColumns({c: F.sum(s).over(upto) for c, s in sums.items()}) if sums else parts
    on = F.col("_p") == F.col("_q")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = own.join(offset, on)
    return out.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_n") + 1).alias(name), *[(F.coalesce(F.col(c), F.lit(0)) + F.col(f"_s_{c}")).alias(c) for c in sums])


def smallest(df: DataFrame, keys: Sequence[str], order: str, k: int, salts: int = 64) -> DataFrame:
    """The k rows of smallest ``order`` of each group; a large group is thinned in parts by salt first."""
    salt = F.pmod(F.xxhash64(order), F.lit(salts))
    w1 = W.partitionBy(*keys, "_salt").orderBy(order)
    w2 = W.partitionBy(*keys).orderBy(order)
    thin = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_salt", "_r")
    return thin.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k).drop("_r")
