"""How filters interact: what each one removes in every order of application.

A document is a set of failed filters, a mask. In the min-plus semiring the step that removes a mask under an
order is the product of a mask matrix (0 where the filter fails, infinity where it passes) with a position matrix
(the inverse permutation of each order): the least position of a failed filter. So documents are read once and
counted by part and mask; the 2**n by n! matrix of removal steps then scatters these counts, weighted, over steps
of all orders. Nothing per document is repeated for the orders.

Equal texts are found by their SHA-256: the least doc_id of each digest is joined back by digest and doc_id,
which no group of copies makes hot.

Defined results: a null or empty text has no words, fails what an empty text fails, and is equal to other such
texts; a null doc_id is neither smaller nor larger than another, so it never fails as a copy; repeated rows count
as one document each, and as equal doc_ids are not smaller they are no copies of each other; null and empty
values of the part are one part; a document is good or toxic if any of its labels says so; an empty table has no
parts and gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark.llm.common import keep, let, words

#: Removal step of a mask that no filter removes; above every position.
NEVER = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Limits of the four filters on a text alone; shares in percent."""

    least_words: int = 100
    least_distinct: int = 80
    most_capitals: int = 10
    symbols: str = "[#$%&*|]"


#: Names of the filters, in the order of the bits of a mask: few words, repeated words, capitals, symbols, copies.
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column, limits: Limits = Limits()) -> Column:
    """Bits of the filters on the whole text: few words (1), repeated words (2), capitals (4), symbols (8)."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))

    def counted(found: Column) -> Column:
        n, distinct = F.size(found), F.size(F.array_distinct(found))
        return (n < limits.least_words).cast("int") + F.when(100 * distinct < limits.least_distinct * n, 2).otherwise(0)

    rest = F.when(100 * capitals.cast("long") > limits.most_capitals * F.char_length(text).cast("long"), 4).otherwise(0)
    return let(words(text), counted) + rest + F.when(text.rlike(limits.symbols), 8).otherwise(0)


def failures(docs: DataFrame, part: str = "lang", limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, mask) of each document; bit 4 of the mask: a smaller doc_id of the whole table has the same text."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), digest.alias("digest"), text_failures(F.col(text), limits).alias("mask"))
    rows = keep(rows)
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def removal_steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of n filters, and the step (from 0) that removes each mask under each: (n!, n) and (2**n, n!)."""
    orders = np.array(list(itertools.permutations(range(n))), np.int64)
    positions = np.argsort(orders, axis=1).T
    fails = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    masks = np.where(fails == 1, 0, NEVER)
    steps = np.full((1 << n, len(orders)), NEVER, np.int64)
    for f in range(n):  # min-plus product, one filter at a time
        np.minimum(steps, masks[:, f, None] + positions[f], out=steps)
    return orders, steps


def scatter(counts: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS by order and step, from the (2**n, 3) numbers of documents, good ones and toxic ones of each mask."""
    n = orders.shape[1]
    held, gone = steps.shape, steps < NEVER
    at = np.broadcast_to(np.arange(held[1]), held)[gone], steps[gone]
    removed, good, toxic = (np.zeros(orders.shape, np.int64) for _ in range(3))
    for k, into in enumerate((removed, good, toxic)):
        np.add.at(into, at, np.broadcast_to(counts[:, k, None], held)[gone])
    fails = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    failing = fails.T @ counts[:, 0]
    letter_removed = np.zeros(n, np.int64)
    np.add.at(letter_removed, orders, removed)
    return {
        "kept": counts[:, 0].sum() - removed.cumsum(1), "removed": removed, "redundant": failing[orders] - removed,
        "unique_fails": counts[1 << np.arange(n), 0][orders], "good_lost": good, "toxic_lost": toxic, "shapley": letter_removed[orders],
    }


def audit(failed: DataFrame, labels: DataFrame, filters: str = FILTERS, doc_id: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    failed: (doc_id, part, mask). Every part has a row for each step of each order.
    """
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    said = said.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad"))
    each = failed.join(said.where("good + bad > 0"), "doc_id", "left")
    counted = each.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    parts = counted.groupBy("part").agg(F.collect_list(F.array(F.col("mask").cast("long"), "n", "good", "bad")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = removal_steps(len(filters))
        names = ["".join(filters[f] for f in o) for o in orders]
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.zeros((1 << len(filters), 3), np.int64)
                for mask, *numbers in cells:
                    counts[mask] += numbers
                found = scatter(counts, orders, steps)
                columns = [pa.array([part] * orders.size), pa.array(np.repeat(names, len(filters))), pa.array(np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[c].ravel()) for c in COUNTS], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
