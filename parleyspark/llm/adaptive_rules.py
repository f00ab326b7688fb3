"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

A sketch is a table of counts by logarithmic bucket (relative error `error`), so sketches merge by adding
counts: one aggregation with map-side sums builds those of all groups, and those of a language or of all
documents are sums of them. Thresholds are fences around each group's quantiles, and documents are judged in
one join with them.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows are judged alike and count as often as they occur; an empty table gives no rows;
other columns stay as they are, and those named like the added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.llm.common import SPACE, join_small, keep, let, unused, words

WINDOW = 5
#: Long counts that measure() adds.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_full_lines"]
#: Bucket of the value zero, below all others.
ZERO = -1_000_000


@dataclass(frozen=True)
class Rules:
    """error: relative error of a quantile. least: documents that a sketch needs; else a wider one judges.

    A fence lies `reach` spreads beyond the `outer` quantile (and below the 1 - outer quantile where a rule
    has a lower side). The spread is the distance between the outer quantile and the median, at least the
    rule's slack, so that a group of alike documents is not cut by noise.

    Rates that are zero in most documents have no spread there. Where it is below the slack, the fence starts
    from the group's own `tail` quantile instead, taken over the values inside the first fence, so that junk
    beyond it does not make itself ordinary.

    A share of few words or lines scatters more than one of many: a fence is `errors` standard errors wider for a
    text of n of them, sqrt(rate * clump / n), where the rate is the mean of the group's values inside
    the first fence, at least the slack, and clump the number of units that occur together. A mean of n words
    has no such error by its own; its room is `noise` slacks / sqrt(n).
    """

    error: float = 0.02
    least: int = 50
    outer: float = 0.75
    reach: float = 6.0
    tail: float = 0.98
    errors: float = 4.0
    noise: float = 60.0

    @property
    def gamma(self) -> float:
        return (1 + self.error) / (1 - self.error)


#: Rule: dividend, divisor, slack, clump (None for a mean), whether it has a lower fence too. A repeat is at least one
#: window of words. One repeated line moves the rates of a clean text of n words by some 26 / n and one line in so
#: many; the slacks leave room for it where base rules do, and no more.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 0.01, 2, False),
    "dup_line_rate": ("n_dup_lines", "n_full_lines", 0.036, 1, False),
    "repeat_rate": ("n_repeat_words", "n_words", 0.018, WINDOW, False),
    "word_length": ("word_chars", "n_words", 0.15, None, True),
}
SIDES = ("low", "high", "room")

#: Columns that adaptive_rules() adds, also for a while; a caller's own of these names are replaced.
ADDED = [*MEASURES, "base_failed", "kept", *[f"{side}_{r}" for r in RATES for side in SIDES]]


def _covered(places: Column) -> Column:
    """Words that windows at these ascending places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]


def _repeated(hashes: Column) -> Column:
    """Ascending places of hashes that occur twice or more: sort, then compare with the neighbours."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    return let(pairs, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))


def _repeat_words(found: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text."""
    starts = F.when(F.size(found) >= WINDOW, F.sequence(F.lit(0), F.size(found) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(WINDOW)]))
    none = F.lit(0).cast("long")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(_repeated(h))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES of each whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = F.struct(
        let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
        F.char_length(F.regexp_replace(whole, f"[{SPACE}]+", "")).alias("c"),
        F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).alias("s"),
    )
    names = dict(zip(MEASURES, ("w.n", "c", "s", "l.d", "w.r", "l.n"), strict=True))
    rest = [c for c in docs.columns if c.lower() not in names]
    # out of a generator, the counts are values that later steps do not compute again
    (name,) = unused(docs, "_counted")
    held = docs.select(*rest, F.explode(F.array(counted)).alias(name))
    return held.select(*rest, *[F.col(f"{name}.{path}").cast("long").alias(n) for n, path in names.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _rate(rule: str) -> Column:
    above, below, *_ = RATES[rule]
    return F.coalesce(F.col(above) / F.greatest(F.col(below), F.lit(1)), F.lit(0.0))


def sketches(measured: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(by..., rule, bucket, n): one quantile sketch for each group and rule, over documents that pass the base rules."""
    scale = 1 / math.log(rules.gamma)
    bucket = lambda x: F.when(x > 0, F.ceil(F.round(F.ln(x) * scale, 6))).otherwise(F.lit(ZERO)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(_rate(r)).alias("bucket")) for r in RATES]))
    rows = measured.where(~base_failed()).select(*by, each.alias("_x")).select(*by, "_x.*")
    return rows.groupBy(*by, "rule", "bucket").agg(F.count("*").alias("n"))


def fences(counts: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(by..., low_<rule>, high_<rule>, room_<rule>): thresholds of each group, from the narrowest sketch with enough documents.

    room: how much wider a fence is for a text of one unit of the rule's divisor; it falls with the square root.

    Sketches of wider groups are sums of the narrow ones: first all, then those before the last column, then all documents.
    """
    levels = [by[: len(by) - k] for k in range(len(by) + 1)]
    at = lambda k: F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in levels[k] else F.lit(None).cast("string")).alias(f"_{c}") for c in by])
    wide = counts.withColumn("_at", F.explode(F.array(*[at(k) for k in range(len(levels))])))
    keys = ["level", *[f"_{c}" for c in by], "rule"]
    wide = wide.select("_at.*", "rule", "bucket", "n").groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys)
    upto = F.sum("n").over(over.orderBy("bucket"))
    ranked = wide.withColumns({"_upto": upto, "_all": F.sum("n").over(over)})
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(rules.gamma), F.col("bucket")) / (rules.gamma + 1))
    of_rule = lambda at: reduce(lambda a, r: F.when(F.col("rule") == r, RATES[r][at]).otherwise(a), RATES, F.lit(None).cast("double"))
    ranked = ranked.withColumns({"_value": value, "_slack": of_rule(2), "_clump": of_rule(3)})
    # every window has the key of the first, so the sketches move once
    quantile = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_value"))).over(over)
    ranked = ranked.withColumns({"_lo": quantile(1 - rules.outer), "_mid": quantile(0.5), "_hi": quantile(rules.outer)})
    out = lambda edge, inner: rules.reach * F.greatest(F.abs(F.col(edge) - F.col(inner)), F.col("_slack"))
    ranked = ranked.withColumns({"_low": F.col("_lo") - out("_mid", "_lo"), "_high": F.col("_hi") + out("_hi", "_mid")})
    inside = F.col("_value") <= F.col("_high")
    ranked = ranked.withColumn("_in", F.max(F.when(inside, F.col("_upto"))).over(over))
    spread = ranked.groupBy(*keys, "_low", "_high", "_slack", "_clump", (F.col("_hi") - F.col("_mid")).alias("_spread")).agg(
        F.max("_all").alias("total"),
        F.min(F.when(F.col("_upto") >= rules.tail * F.col("_in"), F.col("_value"))).alias("_tail"),
        F.round(F.sum(F.when(inside, F.col("_value") * F.col("n"))) / F.max("_in"), 9).alias("_mean"),
    )
    flat = F.col("_clump").isNotNull() & (F.col("_spread") < F.col("_slack"))
    high = F.when(flat, F.greatest("_high", F.col("_tail") + rules.reach * F.col("_slack"))).otherwise(F.col("_high"))
    error = rules.errors * F.sqrt(F.greatest("_mean", "_slack") * F.col("_clump"))
    room = F.coalesce(error, rules.noise * F.col("_slack"))
    spread = spread.select(*keys, "total", F.col("_low").alias("low"), high.alias("high"), room.alias("room"))
    groups = counts.select(*by).distinct().withColumn("_at", F.explode(F.array(*[at(k) for k in range(len(levels))])))
    groups = groups.select(*by, *[F.col(f"_at.{k}").alias(f"g{k}") for k in keys[:-1]])
    met = reduce(lambda a, k: a & F.col(f"g{k}").eqNullSafe(F.col(k)), keys[:-1], F.lit(True))
    usable = F.when((F.col("total") >= rules.least) | (F.col("level") == len(by)), F.col("level"))
    chosen = groups.join(spread, met).groupBy(*by, "rule").agg(F.min_by(F.struct(*SIDES), usable).alias("f"))
    of = lambda r, side: F.max(F.when(F.col("rule") == r, F.col(f"f.{side}"))).alias(f"{side}_{r}")
    return chosen.groupBy(*by).agg(*[of(r, side) for r in RATES for side in SIDES])


def judge(measured: DataFrame, limits: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """measured with base_failed and kept: not base_failed, and no rate outside its group's fences."""
    judged = join_small(measured, limits, list(by), "left")
    inside = F.lit(True)
    for rule, (_, units, *_, lower) in RATES.items():
        room = F.col(f"room_{rule}") / F.sqrt(F.greatest(F.col(units), F.lit(1)))
        inside = inside & F.coalesce(_rate(rule) <= F.col(f"high_{rule}") + room, F.lit(True))
        if lower:
            inside = inside & F.coalesce(_rate(rule) >= F.col(f"low_{rule}") - room, F.lit(True))
    names = [f"{side}_{r}" for r in RATES for side in SIDES]
    return judged.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop(*names)


def adaptive_rules(docs: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("lang", "source"), measured: DataFrame | None = None) -> DataFrame:
    """docs with MEASURES, base_failed and kept.

    measured: measure(docs) if the caller has written it; else texts are read twice, which costs no disk.
    """
    measured = measure(docs) if measured is None else measured
    limits = keep(fences(sketches(measured, rules, by), rules, by))
    return judge(measured, limits, rules, by)
