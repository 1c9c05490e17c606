"""Order-dependent operators that never gather one key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_in_order(df: DataFrame, key: str, order: str, value: str, out: str, span: int = 1024) -> DataFrame:
    """``value`` of the preceding row of the same ``key`` by ``order`` (an integer), null for the first.

    A window over whole keys would put a hot key into one task.  Here rows are
    split into blocks of ``span`` order values; inside a block a plain LAG works
    and the first row of a block takes the last value of the nearest earlier
    block, found on a table that holds one row per block.
    Rows with a null key or order come out with a null result.
    """
    block = F.floor(F.col(order) / F.lit(span)).cast("long")
    d = df.withColumn("__block", block)
    inside = Window.partitionBy(key, "__block").orderBy(order, value)
    d = d.withColumn("__lag", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    last = d.groupBy(key, "__block").agg(F.max(F.struct(order, value)).alias("__last"))
    before = Window.partitionBy(key).orderBy("__block")
    last = last.select(key, "__block", F.lag(f"__last.{value}").over(before).alias("__before"))
    d = d.join(last.hint("merge"), [key, "__block"], "left")
    return d.select(*df.columns, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag")).alias(out))


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without gathering a group in one task.

    The order is deterministic (by salt, then by ``order``), not by ``order``
    alone: each group is split into ``salts`` parts by a hash of ``order``, the
    parts are numbered on their own and shifted by the sizes of the parts before.
    ``order`` should be unique within a group; rows that tie on all of it are
    interchangeable.
    """
    d = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    d = d.withColumn("__rn", F.row_number().over(within) - 1)
    sizes = d.groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__salt").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
    )
    same: Column = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return d.join(sizes, same).select(*df.columns, (F.col("__rn") + F.col("__shift")).cast("long").alias(out))
