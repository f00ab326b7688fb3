"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet token targets per category (of one or more columns), entropy balancing
takes those nearest to one copy of everything, in Kullback-Leibler divergence over tokens. The convex dual has
one multiplier per category, and a document's rate is exp(sum of the multipliers of its categories). Newton
iterations solve it: each pass sums tokens times rate per category in Spark, which is both the gradient's
moving part and the Hessian's block, and steps all multipliers of a column at once.

Rates become copies by a threshold on a hash of the document: every document of a cell (one combination of
categories) has floor(rate) copies, and those with a hash below the cell's threshold one more. Histograms of
tokens by hash prefix, refined 12 bits at a time, find the threshold at which the cell takes its tokens; then
a few single documents are switched to close the rest. So copies are a function of the document and of a
small table of cells: no ranking of rows, and texts are never shuffled.

Defined results: a null text has size 0 and the rate of its source; null sources are one source, the last;
rows with the same id, source and text are taken alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.llm.common import join_small, keep, n_words, unused

#: Bits of a hash prefix that one pass adds, and the number of passes. Draws have 63 bits.
BITS, PASSES = 12, 4
SWITCHES = 4


def weighted_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all tokens. No
    target is above `most` times its source's tokens: what is over goes to the others by weight. This is a
    water level L with sum(min(most * size, L * weight)) = all; sorted by most * size / weight, the capped
    sources come first, and two running sums give L. These windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = lambda c, start: start - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    budget = share * F.sum("source_size").over(every)
    rows = rows.withColumn("level", left("cap", budget) / left("weight", F.sum("weight").over(every)))
    # at the first source that is not capped; levels of later ones are lower
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


@dataclass(frozen=True)
class Newton:
    """tolerance: largest relative miss of a target at which iterations end. stride: longest step of a multiplier."""

    tolerance: float = 1e-9
    steps: int = 60
    stride: float = 1.0


def multipliers(cells: DataFrame, targets: dict[str, DataFrame], newton: Newton = Newton()) -> dict[str, DataFrame]:
    """Dual solution: for each column of targets a table (column, multiplier).

    cells: (columns of targets..., size), tokens of each combination. targets: (column, target) for each
    column. A target of zero, or of a category without tokens, gives a rate of zero.
    """
    start = {c: keep(t.select(c, "target", F.lit(0.0).alias("multiplier"))) for c, t in targets.items()}
    state = dict(start)
    for _ in range(newton.steps):
        worst = 0.0
        for column in targets:
            tilted = F.exp(sum((F.col(f"_m_{c}") for c in state), F.lit(0.0)))
            rows = cells
            for c, t in state.items():
                rows = join_small(rows, t.select(c, F.col("multiplier").alias(f"_m_{c}")), [c], "inner")
            sums = rows.groupBy(column).agg(F.sum(F.col("size") * tilted).alias("_sum"))
            now = join_small(state[column], keep(sums), [column], "left")
            open_ = (F.col("target") > 0) & (F.col("_sum") > 0)
            step = F.greatest(F.least(F.col("target") / F.col("_sum") - 1, F.lit(newton.stride)), F.lit(-newton.stride))
            miss = F.when(open_, F.abs(F.col("_sum") / F.col("target") - 1)).otherwise(0.0)
            now = keep(now.select(column, "target", F.when(open_, F.col("multiplier") + step).otherwise(-750.0).alias("multiplier"), miss.alias("_miss")))
            worst = max(worst, now.agg(F.max("_miss")).first()[0] or 0.0)
            state[column] = now.drop("_miss")
        if worst <= newton.tolerance:
            break
    return {c: t.select(c, "multiplier") for c, t in state.items()}


def draw(doc_id: str = "doc_id", text: str = "text") -> Column:
    """63 bits of a hash of the document, by which it is taken."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), 1)


def below(draw_: Column, prefix: Column, last: Column) -> Column:
    """Whether a draw is below the threshold: by its first bits, and at the very prefix if `last` says so."""
    head = F.shiftright(draw_, 63 - BITS * PASSES)
    return (head < prefix) | ((head == prefix) & last)


def thresholds(units: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """(by..., whole, prefix, last, target): of the units of a cell, all get `whole` copies, and those below the threshold one more."""
    cells = units.groupBy(*by).agg(F.sum("size").alias("_all"))
    state = join_small(cells, rates, by, "inner").withColumn("whole", F.floor("rate").cast("int"))
    state = state.withColumns({"target": F.col("rate") * F.col("_all"), "need": (F.col("rate") - F.col("whole")) * F.col("_all"), "prefix": F.lit(0).cast("long")})
    state = keep(state.select(*by, "whole", "target", "need", "prefix"))
    for k in range(1, PASSES + 1):
        rows = join_small(units, state, by, "inner")
        rows = rows.where(F.shiftright("draw", 63 - BITS * (k - 1)) == F.col("prefix"))
        rows = rows.withColumn("_b", F.shiftright("draw", 63 - BITS * k))
        sums = rows.groupBy(*by, "_b").agg(F.sum("size").alias("_n"), *[F.first(c).alias(c) for c in ("whole", "target", "need")])
        over = Window.partitionBy(*by)
        sums = sums.withColumns({"_upto": F.sum("_n").over(over.orderBy("_b")), "_top": F.max("_b").over(over)})
        reached = F.when((F.col("_upto") >= F.col("need")) | (F.col("_b") == F.col("_top")), F.col("_b"))
        sums = sums.groupBy(*by).agg(F.min_by(F.struct("whole", "target", (F.col("need") - F.col("_upto") + F.col("_n")).alias("need"), F.col("_b").alias("prefix"), F.col("_n").alias("n")), reached).alias("s"))
        state = keep(sums.select(*by, "s.*"))
    return keep(state.select(*by, "whole", "prefix", (F.col("need") * 2 > F.col("n")).alias("last"), "target"))


def switched(units: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., draw): at most SWITCHES units of a cell whose extra copy is turned over, to come nearer to its target."""
    flips = None
    base = keep(join_small(units, cells, by, "inner").select(*by, "draw", "size", "whole", "target", below(F.col("draw"), F.col("prefix"), F.col("last")).alias("extra")))
    for _ in range(SWITCHES):
        now = base
        if flips is not None:
            now = join_small(base, flips.withColumn("_flip", F.lit(True)), [*by, "draw"], "left")
            now = now.withColumn("extra", F.col("extra") != F.coalesce(F.col("_flip"), F.lit(False)))
        taken = F.sum(F.col("size") * (F.col("whole") + F.col("extra").cast("int")))
        gap = keep(now.groupBy(*by).agg((F.first("target") - taken).alias("gap")))
        rows = join_small(now, gap, by, "inner")
        miss = F.abs(F.col("size") - F.abs("gap"))
        useful = ((F.col("gap") > 0) != F.col("extra")) & (miss < F.abs("gap"))
        best = rows.where(useful).groupBy(*by).agg(F.min_by("draw", F.struct(miss, F.col("draw"))).alias("draw"))
        if flips is not None:  # a unit that is turned over twice is as it was
            best = flips.unionByName(best).groupBy(*by, "draw").agg(F.count("*").alias("_n")).where("_n % 2 = 1").drop("_n")
        flips = keep(best)
    return flips


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target (of the source) and mix_copies (0 to most); names are changed if taken."""
    out = unused(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    rows = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), draw(doc_id, text).alias("draw"))
    units = keep(rows.groupBy("source", "draw").agg(F.sum("size").alias("size")))
    targets = keep(weighted_targets(units, weights, share, most))
    tilt = multipliers(targets.select("source", F.col("source_size").alias("size")), {"source": targets.select("source", "target")})["source"]
    rates = keep(tilt.select("source", F.least(F.exp("multiplier"), F.lit(most)).alias("rate")))
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-8
    rates = keep(rates.withColumn("rate", F.when(near, F.round("rate")).otherwise(F.col("rate"))))
    cells = thresholds(units, rates, ["source"])
    flips = switched(units, cells, ["source"])
    known = keep(join_small(targets, cells.drop("target"), ["source"], "left"))
    return _with_copies(docs, known, flips, out, doc_id, source, text)


def _with_copies(docs: DataFrame, known: DataFrame, flips: DataFrame, out: list[str], doc_id: str, source: str, text: str) -> DataFrame:
    held = dict(zip(("source", "draw", "flip", "source_size", "target", "whole", "prefix", "last"), unused(docs, *[f"_mix_{k}" for k in range(8)]), strict=True))
    rows = docs.withColumns({held["source"]: F.col(source), held["draw"]: draw(doc_id, text), out[0]: n_words(F.col(text))})
    rows = join_small(rows, known.withColumnsRenamed(held), [held["source"]], "left")
    rows = join_small(rows, flips.withColumn("flip", F.lit(True)).withColumnsRenamed(held), [held["source"], held["draw"]], "left")
    extra = below(*[F.col(held[c]) for c in ("draw", "prefix", "last")])
    extra = extra != F.coalesce(F.col(held["flip"]), F.lit(False))
    rows = rows.withColumns({out[1]: F.col(held["source_size"]), out[2]: F.col(held["target"]), out[3]: F.coalesce(F.col(held["whole"]) + extra.cast("int"), F.lit(0))})
    return rows.drop(*held.values())
