"""Line dedup over levelled sorted runs of line hashes.

Narrow entries (document, line hash) leave the texts once. They come in batches, by descending ranges of doc_id. A
batch is summed per hash and merge-anti-joined with the live runs: a hash is settled in a run that counts enough
documents for it and holds an owner no smaller than the batch's, and nothing more can change for it, so the
batch drops it. What is left, fresh or unsettled, becomes a run of its own. As the largest documents come first, a
line that many share is settled within the first batches and stored in few runs, however often it occurs later. When a
level has `fanout` runs, they are merged into one run of the next level, so the number of live runs stays
logarithmic in the number of batches; counts stop at the number that settles a hash. A run is a table of (hash,
documents, owner), bucketed and sorted by hash: joining a batch with it moves the batch only. Merging reads the runs'
files as plain ones, for a union of bucketed tables is grouped wrongly: each table's buckets count as dealt alike
even where the scan is not by bucket. Batches in another order give the same result, but store more; ids that are no
numbers come by hash.

A line goes if its hash is in at least `least` documents and its document is not the owner, the largest
doc_id that holds it. Only those lines travel back: each document gets the places of its dropped lines.

Defined results: a null or empty text is one empty line; lines repeated inside a document count once, and all
go or stay together; a hash is 128 bits of two hash functions; rows with the same doc_id are one document and
owners together; a null doc_id is below every other, and rows without one are told apart by text; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from parleyspark.llm.common import ascii_lower, keep, let, unused
from parleyspark.session import checkpoint_root
from parleyspark.sources.files import remove

STRIP = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def line_hash(line: Column, shortest: int) -> Column:
    """128-bit hash of the line's key as a struct, null if the key is too short to count."""
    made = lambda k: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit("second"), k).alias("g"))
    return let(line_key(line), lambda k: F.when(F.char_length(k) >= shortest, made(k)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass
class LineRuns:
    """Live runs by level. Tables lie in the shared folder; `buckets` is fixed for the life of the runs. least: documents that
    settle a hash. owner: type of doc_id."""

    spark: SparkSession
    buckets: int
    least: int = 3
    fanout: int = 4
    owner: str = "bigint"
    levels: list[list[str]] = field(default_factory=list)

    def _path(self, name: str) -> str:
        return f"{checkpoint_root(self.spark).rstrip('/')}/{name}"

    def _write(self, rows: DataFrame) -> str:
        name = f"llm_run_{uuid.uuid4().hex}"
        dealt = rows.select("h", "g", "n", "owner").repartition(self.buckets, "h", "g")
        dealt.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", self._path(name)).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _summed(self, rows: DataFrame, n: Column, owner: str) -> DataFrame:
        return rows.groupBy("h", "g").agg(F.least(n, F.lit(self.least).cast("long")).alias("n"), F.max(owner).alias("owner"))

    def _merged(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.schema("h bigint, g bigint, n bigint, owner " + self.owner).parquet(*map(self._path, names))
        return self._summed(rows, F.sum("n"), "owner")

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows (h, g, n, owner) of a batch that no run settles."""
        for run in self.runs():
            done = run.where(F.col("n") >= self.least).select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("owner").alias("_owner"))
            same = (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
            batch = batch.join(done, same & (F.col("owner").isNull() | (F.col("owner") <= F.col("_owner"))), "left_anti")
        return batch

    def add(self, entries: DataFrame) -> None:
        """entries: (doc_id, h, g), each hash once a document. Adds one run; compacts levels that are full."""
        self._place(self._write(self.unsettled(self._summed(entries, F.count("*"), "doc_id"))), 0)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(self._write(self._merged(full)), level + 1)
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self._path(name))

    def shared(self) -> DataFrame:
        """(h, g, owner) of settled hashes, over all runs."""
        names = [name for level in self.levels for name in level]
        return self._merged(names).where(F.col("n") >= self.least).select("h", "g", "owner")

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = []


def _descending(docs: DataFrame, doc_id: str, batches: int) -> Column:
    """Batch of a doc_id, from 0 for the largest; null comes last."""
    if not isinstance(docs.schema[doc_id].dataType, NumericType):
        return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"), F.lit(batches - 1))
    shares = F.array(*[F.lit(k / batches) for k in range(1, batches)])
    bounds = docs.agg(F.percentile_approx(doc_id, shares, 10_000)).first()[0] if batches > 1 else None
    after = [(F.col("doc_id") <= F.lit(b)).cast("int") for b in bounds or []]
    return F.coalesce(reduce(Column.__add__, after, F.when(F.col("doc_id").isNotNull(), 0)), F.lit(batches - 1))


def _cut(whole: Column, places: Column) -> Column:
    """whole without the elements at the ascending places: the stretches between them, joined."""
    ends = F.concat(places, F.array(F.size(whole)))
    stretches = let(ends, lambda e: F.transform(e, lambda p, k: let(F.coalesce(F.get(e, k - 1), F.lit(-1)), lambda q: F.slice(whole, q + 2, p - q - 1))))
    return F.flatten(stretches)


def dropped_lines(docs: DataFrame, shortest: int = 20, least: int = 3, batches: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, places): ascending places, from 0, of the lines that go; only documents with such lines."""
    spark = docs.sparkSession
    places = F.filter(F.transform(lines(F.col(text)), lambda x, i: F.struct(line_hash(x, shortest).alias("key"), i.alias("place"))), lambda x: x["key"].isNotNull())
    # sorted by key, so that the first place of a key, which stands for its document, is known by its neighbour
    marked = let(F.array_sort(places), lambda s: F.transform(s, lambda x, k: F.struct(x["key"]["h"].alias("h"), x["key"]["g"].alias("g"), x["place"].alias("place"), (~F.get(s, k - 1)["key"].eqNullSafe(x["key"])).alias("first"))))
    each = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), F.explode(marked).alias("e"))
    # what tells documents apart: the id, or else the text; rows of one document share a batch
    own = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    entries = keep(each.select("doc_id", "text_hash", "e.*", own.alias("own"), _descending(docs, doc_id, batches).alias("batch")))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, buckets, least, owner=entries.schema["doc_id"].dataType.simpleString())
    try:
        for k in range(batches):
            runs.add(entries.where(f"batch = {k} and first").select("doc_id", "own", "h", "g").distinct())
        owners = keep(runs.shared())
    finally:
        runs.close()
    gone = entries.join(owners, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, shortest: int = 20, least: int = 3, batches: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with line_count (long, before), dropped_count (long) and kept_text; names are changed if taken."""
    out = unused(docs, "line_count", "dropped_count", "kept_text")
    held = unused(docs, "_line_id", "_line_hash", "_line_places", "_line_split")
    gone = keep(dropped_lines(docs, shortest, least, batches, doc_id, text)).withColumnsRenamed({"doc_id": held[0], "text_hash": held[1], "places": held[2]})
    met = F.col(doc_id).eqNullSafe(F.col(held[0])) & (text_hash(F.col(text)) == F.col(held[1]))
    rows = docs.join(gone, met, "left")
    split, places = lines(F.col(text)), F.col(held[2])
    kept = F.when(places.isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(let(split, lambda x: F.array_join(_cut(x, places), "\n")))
    rows = rows.withColumns({out[0]: F.size(split).cast("long"), out[1]: F.coalesce(F.size(places), F.lit(0)).cast("long"), out[2]: kept})
    return rows.drop(*held)
