"""Long jobs in chunks that survive being stopped.

A job's rows are cut into chunks by ranges of their id, so that a chunk's filter reaches the scan. The bounds are
written once and stay for the life of the job; the first and last range are open, so rows that come later fall into
one of them. Each run of a chunk commits a part of its own, a folder that counts once Spark has marked it complete.
A row is done if a complete part holds its id: a run that was stopped goes on with the first row that is in none,
and a half-written part counts for nothing and is removed.

Defined results: a row whose id is null belongs to the first chunk and is done once that chunk has a part with a
null id; rows with the same id are worked on together, in the first run that sees one; rows that the work leaves out
are worked on again by each run, as nothing says that they were done; an empty table makes no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleyspark.sources.files import exists, matching, remove

Work = Callable[[DataFrame], DataFrame]


class ChunkedJob:
    """``key``: the id, a number, kept by the work. ``chunks``: how many ranges the first run cuts."""

    def __init__(self, spark: SparkSession, path: str, key: str, chunks: int = 16):
        if chunks < 1:
            raise ValueError("a job has at least one chunk")
        self.spark, self.path, self.key, self.chunks = spark, path.rstrip("/"), key, chunks

    def _bounds(self, rows: DataFrame) -> list:
        """Inner bounds of the ranges, ascending; those of the first run, whatever came since."""
        path = f"{self.path}/bounds"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            shares = [k / self.chunks for k in range(1, self.chunks)]
            cut = F.percentile_approx(self.key, F.array(*map(F.lit, shares)), 100 * self.chunks) if shares else F.lit(None)
            rows.agg(cut.alias("bounds")).write.mode("overwrite").parquet(path)
        return sorted(set(self.spark.read.parquet(path).first()["bounds"] or []))

    def _range(self, low, high) -> Column:
        key, held = F.col(self.key), F.lit(True)
        if low is None:
            held = key.isNull()
            return held | (key <= high) if high is not None else F.lit(True)
        return (key > low) & (key <= high) if high is not None else key > low

    def _parts(self, chunk: int) -> list[str]:
        return [p.removesuffix("/_SUCCESS") for p in matching(self.spark, f"{self.path}/chunk={chunk}/part-*/_SUCCESS")]

    def _clean(self, chunk: int) -> None:
        whole = set(self._parts(chunk))
        for part in matching(self.spark, f"{self.path}/chunk={chunk}/part-*"):
            if part not in whole:
                remove(self.spark, part)

    def pending(self, rows: DataFrame, chunk: int, low, high) -> DataFrame:
        """Rows of a chunk that no complete part of it holds."""
        todo = rows.filter(self._range(low, high))
        parts = self._parts(chunk)
        if not parts:
            return todo
        done = self.spark.read.parquet(*parts).select(F.col(self.key).alias("_done")).distinct()
        return todo.join(done, F.col(self.key).eqNullSafe(F.col("_done")), "left_anti")

    def run(self, rows: DataFrame, work: Work, stop_after: int | None = None) -> list[tuple[int, int]]:
        """(chunk, rows written) of the chunks that had something to do; ``stop_after`` ends the run after so many of them.

        One run at a time: a second one beside it would take the first one's open part for a broken one.
        """
        bounds = self._bounds(rows)
        written = []
        for chunk, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
            if stop_after is not None and len(written) >= stop_after:
                break
            self._clean(chunk)
            part = f"{self.path}/chunk={chunk}/part-{uuid.uuid4().hex}"
            work(self.pending(rows, chunk, low, high)).write.parquet(part)
            n = self.spark.read.parquet(part).count()
            if n == 0:
                remove(self.spark, part)
            else:
                written.append((chunk, n))
        return written

    def ledger(self) -> DataFrame:
        """(chunk, rows) of what complete parts hold."""
        return self.result().groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))

    def result(self) -> DataFrame:
        """All rows of complete parts, with their chunk. Raises FileNotFoundError before the first part."""
        parts = [p.removesuffix("/_SUCCESS") for p in matching(self.spark, f"{self.path}/chunk=*/part-*/_SUCCESS")]
        if not parts:
            raise FileNotFoundError(f"{self.path} has no complete part")
        return self.spark.read.option("basePath", self.path).parquet(*parts)
