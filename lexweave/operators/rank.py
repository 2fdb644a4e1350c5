"""Keep-first, best-row and top-k operators that stay safe on hot keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark trims each map task's rows per group before the shuffle up to this k
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The group limit runs on the map side too, so a key holding most of the table
    ships one row per map task.
    """
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank_col: str | None = None, salts: int = 64) -> DataFrame:
    """First ``k`` rows per group, optionally numbered.

    Beyond the group-limit threshold the same trimming is done in two levels: first within
    ``salts`` slices of each group, then over at most ``salts * k`` survivors.
    """
    rn = "__rn"
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
        inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", salt).withColumn(rn, F.row_number().over(inner))
              .where(F.col(rn) <= k).drop(rn, "__salt"))
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) <= k)
    return out.withColumnRenamed(rn, rank_col) if rank_col else out.drop(rn)


def first_non_null(value: Column, order: Column) -> Column:
    """Aggregate: the value at the smallest ``order`` where it is not null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def prefix_sum(df: DataFrame, key: str, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum per key that splits a hot key by ``bucket``.

    ``bucket`` must be non-decreasing along ``order`` within a key. Bucket totals are summed
    first (partial aggregation), so no task ever holds one key's whole history.
    """
    total, before = f"__{out}_total", f"__{out}_before"
    totals = df.groupBy(key, bucket).agg(F.sum(value).alias(total))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, bucket, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(starts, [key, bucket])
        .withColumn(out, F.col(before) + F.sum(value).over(inside))
        .drop(before)
    )
