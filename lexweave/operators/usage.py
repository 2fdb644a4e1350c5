"""Usage metering: lifetime totals per account, and the cap on new calls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.rank import prefix_sum


def charge(input_tokens: str = "input_tokens", output_tokens: str = "output_tokens") -> Column:
    """Tokens a call costs; missing or negative counts are zero."""
    z = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    return z(input_tokens) + z(output_tokens)


def running_totals(calls: DataFrame, bucket: str = "hour") -> DataFrame:
    """Every call with its account's lifetime total after it.

    ``calls``: ``user_id, event_id, ts, input_tokens, output_tokens``. A busy account's history is
    split by time bucket.
    """
    c = calls.withColumn("tokens", charge()).withColumn("__b", F.date_trunc(bucket, "ts"))
    return prefix_sum(c, "user_id", "__b", [F.col("ts"), F.col("event_id")], "tokens", "total_after").drop("__b")


def account_totals(calls: DataFrame) -> DataFrame:
    z = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    return calls.groupBy("user_id").agg(F.sum(z("input_tokens")).alias("total_input"), F.sum(z("output_tokens")).alias("total_output"))


def is_exempt(email, exempt: list[str]) -> Column:
    e = F.lower(F.trim(F.coalesce(F.col(email) if isinstance(email, str) else email, F.lit(""))))
    return e.isin([x.strip().lower() for x in exempt]) if exempt else F.lit(False)


def gate(calls: DataFrame, limit: int, exempt: list[str] = (), opening: DataFrame | None = None, bucket: str = "hour") -> DataFrame:
    """Decide every call: ``admitted`` and the total charged so far.

    The call that crosses the limit is charged and the next one refused; refused calls cost nothing.
    Exempt accounts are always admitted. ``opening`` (``user_id, opening``) carries earlier totals.
    """
    r = running_totals(calls, bucket)
    start = F.lit(0)
    if opening is not None:
        r = r.join(opening, "user_id", "left")
        start = F.coalesce("opening", F.lit(0))
    before = start + F.col("total_after") - F.col("tokens")
    admitted = is_exempt("email", list(exempt)) | (before < limit)
    return (
        r.withColumn("admitted", admitted).withColumn("total_after", start + F.col("total_after"))
        .withColumn("charged", F.when(F.col("admitted"), F.col("tokens")).otherwise(F.lit(0)))
    )


def charged_totals(decided: DataFrame) -> DataFrame:
    return decided.groupBy("user_id").agg(F.sum("charged").alias("total"), F.count_if("admitted").alias("n_admitted"), F.count_if(~F.col("admitted")).alias("n_refused"))
