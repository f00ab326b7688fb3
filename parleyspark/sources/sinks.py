"""Writers: routed outputs, thread trees, ledgers, reports, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleyspark.operators import gates as G
from parleyspark.session import written


def append_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    writer = df.select(*fields).write.mode("append").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_routed(outcome: DataFrame, path: str, mode: str = "append") -> None:
    """Accepted and quarantined rows in one pass, one folder per status."""
    outcome.write.mode(mode).partitionBy("status").parquet(path)


def read_routed(spark, path: str, status: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("status") == status).drop("status")


def release_from_quarantine(quarantine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to keep in quarantine, rows to try again)."""
    out = G.released(F.col("fail_reason"))
    return quarantine.filter(~out), quarantine.filter(out)


def write_split_errors(scored: DataFrame, path: str, label: str, pred: str) -> None:
    """Scored rows and those predicted wrongly, a folder for each split, in one pass."""
    kinds = F.when(F.col(label) != F.col(pred), F.array(F.lit("scored"), F.lit("errors"))).otherwise(F.array(F.lit("scored")))
    scored.withColumn("kind", F.explode(kinds)).write.mode("overwrite").partitionBy("kind", "split").parquet(path)


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_thread_tree(threads: DataFrame, path: str) -> None:
    """Tree by length, script, label and split; the old tree is replaced.

    Rows are clustered by cell first, so a cell gets few files and readers that
    filter on these fields open only their folders. A salt keeps one large cell
    from becoming one task.
    """
    keys = ["length", "script", "label", "split"]
    salt = F.pmod(F.xxhash64("thread_id"), F.lit(8))
    clustered = threads.repartition(*keys, salt)
    clustered.write.mode("overwrite").partitionBy(*keys).json(path)


def write_splits(threads: DataFrame, path: str) -> None:
    """Threads sorted by id within range-partitioned files per split."""
    ranged = threads.repartitionByRange("split", "thread_id").sortWithinPartitions("split", "thread_id")
    ranged.write.mode("overwrite").partitionBy("split").json(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Daily rows sorted by key with six decimals; the grand total is left out."""
    keys = ["date_utc", "job", "service", "model"]
    rows = ledger.filter(F.col("date_utc").isNotNull()).orderBy(*keys)
    money = F.format_string("%.6f", "usd_estimated").alias("usd_estimated")
    rows = rows.select(*keys, "n_calls", "input_tokens", "output_tokens", money, F.lit("").alias("notes"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def prediction_dump(df: DataFrame, turns: str, probs: Sequence[str]) -> DataFrame:
    """Last three turns and rounded class probabilities per row."""
    tail = F.slice(turns, F.greatest(F.size(turns) - 2, F.lit(1)), F.lit(3))
    rounded = [F.transform(p, lambda x: F.round(x.cast("double"), 4)).alias(p) for p in probs]
    rest = [c for c in df.columns if c not in (turns, *probs)]
    return df.select(*rest, tail.alias(turns), *rounded)


def _bounded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """rows, for a document that one task writes; a table that is too large for one is an error, not a cut."""
    held = written(rows.limit(most + 1))
    if held.count() > most:
        raise ValueError(f"{what} takes at most {most} rows; write the table itself instead")
    return held


def export_incidents(log: DataFrame, order: str, most: int = 10_000) -> str:
    """The capped log as one JSON document, newest first. More than ``most`` rows are an error."""
    ordered = F.transform(
        F.reverse(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct("*").alias("row"))))), lambda s: s["row"]
    )
    log = _bounded(log, most, "an export")
    return log.agg(F.to_json(F.struct(F.current_timestamp().alias("exportedAt"), ordered.alias("incidents"))).alias("j")).first()["j"]


def write_report(metrics: DataFrame, path: str, most: int = 100_000) -> None:
    """Metric rows (section, key, metric, value) as one JSON document, in order. More than ``most`` rows are an error."""
    rows = F.sort_array(F.collect_list(F.struct("section", "key", "metric", "value")))
    _bounded(metrics, most, "a report").agg(F.to_json(F.struct(rows.alias("metrics"))).alias("value")).write.mode("overwrite").text(path)


def long_metrics(df: DataFrame, section: str, key: str) -> DataFrame:
    """Wide metric row per key turned into (section, key, metric, value)."""
    values = [c for c in df.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.inline(pairs))


def dataset_card(marginals: DataFrame) -> str:
    """Short markdown summary from the marginal counts, 10,000 at most."""
    shown = _bounded(marginals.filter(F.col("grouping") != "length+script+label"), 10_000, "a card")
    rows = shown.orderBy("grouping", "value").collect()
    lines = ["# Dataset", ""]
    for name in dict.fromkeys(r["grouping"] for r in rows):
        lines += [f"## {name}", "", "| value | rows |", "| --- | --- |"]
        lines += [f"| {r['value'] or 'all'} | {r['n']} |" for r in rows if r["grouping"] == name] + [""]
    return "\n".join(lines)
