"""Plugging a scorer in, and scoring each distinct text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from parleyspark.session import cut_lineage


def batch_scorer(make_predict: Callable[[], Callable], batch_size: int = 64, classes: int = 1) -> Callable[[Column], Column]:
    """Column scorer from a function that loads a model on the executor.

    ``make_predict`` returns predict(texts) -> probabilities; Spark feeds it
    Arrow batches and caches the loaded model per worker. With several classes
    predict gives a row of them for each text, and the column is an array.
    """
    from pyspark.ml.functions import predict_batch_udf

    kind = ST.DoubleType() if classes == 1 else ST.ArrayType(ST.DoubleType())
    return predict_batch_udf(make_predict, return_type=kind, batch_size=batch_size)


def cached_scores(rows: DataFrame, text: str, scorer: Callable[[Column], Column], path: str, out: str = "score") -> DataFrame:
    """Scores of distinct texts, kept in a table at ``path`` by text hash.

    Only texts that the table lacks are scored; their scores are appended to it
    before rows are joined, so the next run finds them.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    fresh = keyed.groupBy("_key").agg(F.first(text).alias("_text"))
    try:
        fresh = fresh.join(spark.read.parquet(path).select("_key"), "_key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.select("_key", scorer(F.col("_text")).alias("_score")).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "_key", "left").withColumnRenamed("_score", out).drop("_key")


def score_unique(rows: DataFrame, text: str, scorer: Callable[[Column], Column], out: str = "score") -> DataFrame:
    """Score distinct texts once and map the scores back.

    Joined on a fixed-width hash of the text. The scores are written before the
    join: both sides are then plain inputs, and adaptive execution can split the
    partition of a text that is repeated very often.
    """
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    unique = keyed.groupBy("_key").agg(F.first(text).alias("_text"))
    scored = cut_lineage(unique.select("_key", scorer(F.col("_text")).alias(out)))
    return keyed.join(scored, "_key", "left").drop("_key")
