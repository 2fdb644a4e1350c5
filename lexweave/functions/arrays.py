"""Array helpers that stay linear on long arrays."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def fixed_once(df: DataFrame, *keep: str, **values: Column) -> DataFrame:
    """``keep`` and the named values, each worked out once a row: what is asked of them later is not moved below, where it would work them out again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def _short_sums(values: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["sums"], F.array(a["at"] + v)).alias("sums")), lambda a: a["sums"])


def running_sums(values: Column) -> Column:
    """Running sums: within blocks of about the root of the length, then over the blocks, so that no step copies a long array."""
    def blocks(v):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda j: _short_sums(F.slice(v, j * width + 1, width)))

    def shifted(parts):
        return let(_short_sums(F.transform(parts, lambda p: F.element_at(p, -1))), lambda offs: F.flatten(
            F.transform(parts, lambda p, j: F.transform(p, lambda x: x + F.when(j > 0, F.get(offs, j - 1)).otherwise(0)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), shifted)).otherwise(F.array().cast("array<bigint>")))
