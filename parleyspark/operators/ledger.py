"""Cost arithmetic and the daily ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark import config as C


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices=C.TOKEN_PRICES) -> Column:
    """USD of a call; unknown models take the default price."""
    p_in, p_out = F.lit(C.DEFAULT_TOKEN_PRICE[0]), F.lit(C.DEFAULT_TOKEN_PRICE[1])
    for name, (a, b) in prices.items():
        p_in = F.when(model == name, F.lit(a)).otherwise(p_in)
        p_out = F.when(model == name, F.lit(b)).otherwise(p_out)
    return (tokens_in.cast("double") * p_in + tokens_out.cast("double") * p_out) / F.lit(1_000_000.0)


def ledger(calls: DataFrame) -> DataFrame:
    """Calls, tokens and USD per day, job, service and model, with a grand total."""
    zero = F.lit(0)
    keys = [F.to_date("ts_utc").alias("date_utc"), "job", "service", "model"]
    rows = calls.select(
        *keys,
        F.coalesce("input_tokens", zero).alias("i"),
        F.coalesce("output_tokens", zero).alias("o"),
        F.coalesce("usd_estimated", F.lit(0.0)).alias("u"),
    )
    names = ["date_utc", "job", "service", "model"]
    cols = [F.col(c) for c in names]
    return rows.groupingSets([cols, []], *cols).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("i").alias("input_tokens"),
        F.sum("o").alias("output_tokens"),
        F.sum("u").alias("usd_estimated"),
    )


def billed_hours(launch: Column, end: Column) -> Column:
    """Hours between two timestamps with the minimum billing time."""
    seconds = (F.unix_micros(end.cast("timestamp")).cast("double") - F.unix_micros(launch.cast("timestamp")).cast("double")) / 1e6
    return F.greatest(seconds, F.lit(float(C.MIN_BILLED_SECONDS))) / F.lit(3600.0)


def compute_cost(hours: Column, hour_price: Column, disk_gb: Column, disk_price: Column, stored_gb: Column) -> dict[str, Column]:
    month = F.lit(C.HOURS_PER_MONTH)
    return {
        "compute_usd": hour_price * hours,
        "disk_usd": disk_price * disk_gb * hours / month,
        "store_usd": stored_gb * F.lit(C.OBJECT_STORE_GB_MONTH) * (hours / month),
    }


def parse_end_time(text: Column) -> Column:
    """Timestamp inside '(yyyy-mm-dd hh:mm:ss GMT)'."""
    found = F.regexp_extract(text, r"\((\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) GMT\)", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))


def retry_delay(attempt: Column, base: float = 500.0, factor: float = 2.0, ceiling: float = 8000.0) -> Column:
    """Milliseconds before the given retry, counted from one."""
    return F.least(F.lit(ceiling), F.lit(base) * F.pow(F.lit(factor), attempt - 1))
