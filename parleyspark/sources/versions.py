"""Small tables kept as whole versions in a shared folder.

A version is written beside the others and counts once Spark's commit has marked it complete, so readers always see
a whole table. Numbers are those of micro-batches: a retried batch writes its own version again from the one
before it. A version that is not a batch's, such as a cleared table, follows the newest one at the same number.
The last few versions are kept, the rest is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Written last by Spark's commit of a folder.
DONE = "_SUCCESS"


class Versions:
    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        if keep < 2:
            raise ValueError("a retried batch needs the version before its own: keep at least 2")
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, number: int, step: int) -> str:
        return f"{self.path}/version-{number:012d}-{step:06d}"

    def _path(self, number: int, step: int, *more: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self._at(number, step), *more]))

    def numbers(self) -> list[tuple[int, int]]:
        """(number, step) of the complete versions, oldest first."""
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        found = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("version-")]
        return sorted(v for v in found if self._files.exists(self._path(*v, DONE)))

    def newest(self, below: int | None = None) -> tuple[int, int] | None:
        """Newest complete version, of those with a smaller number than ``below``."""
        return max((v for v in self.numbers() if below is None or v[0] < below), default=None)

    def read(self, below: int | None = None) -> DataFrame | None:
        at = self.newest(below)
        return None if at is None else self.spark.read.parquet(self._at(*at))

    def write(self, df: DataFrame, number: int, step: int = 0) -> None:
        df.write.mode("overwrite").parquet(self._at(number, step))
        self.prune()

    def clear(self) -> None:
        """An empty version after the newest one. Without any version there is nothing to clear."""
        at = self.newest()
        if at is not None:
            self.write(self.spark.createDataFrame([], self.read().schema), at[0], at[1] + 1)

    def prune(self) -> None:
        """Remove all but the last ``keep`` numbers, and of each but the newest number the steps before its last."""
        found = self.numbers()
        recent = sorted({n for n, _ in found})[-self.keep :]
        last = {n: max(s for m, s in found if m == n) for n in recent}
        for number, step in found:
            if number not in last or step < last[number] and number != recent[-1]:
                self._files.delete(self._path(number, step), True)
