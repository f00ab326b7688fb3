"""Ordered quality gates: the first failing rule names the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import text as T

Rule = tuple[str | Column, Column]


def first_failure(rules: Sequence[Rule], passed: str | None = "ok") -> Column:
    """Reason of the first true predicate, else ``passed``."""
    picks = [F.when(p, r if isinstance(r, Column) else F.lit(r)) for r, p in rules]
    return F.coalesce(*picks, F.lit(passed))


def any_of(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


# --- lexicon -------------------------------------------------------------------
def has_stem(source: Column, lexicon=C.MARKERS) -> Column:
    return any_of([F.contains(source, F.lit(m.stem)) for m in lexicon])


def lexicon_preserved(source: Column, output: Column, lexicon=C.MARKERS, folded_only: bool = False) -> Column:
    """Some surface of some stem found in the source must appear in the output."""
    lowered, folded = F.lower(output), T.fold_obfuscation(output)
    kept = []
    for m in lexicon:
        hits = []
        for s in m.surfaces:
            fold = s.lower()
            for mark in ".-_*@":
                fold = fold.replace(mark, "")
            hits += [F.contains(folded, F.lit(s)) if folded_only else F.contains(lowered, F.lit(s))]
            hits += [F.contains(folded, F.lit(fold))]
        kept.append(F.contains(source, F.lit(m.stem)) & any_of(hits))
    return ~has_stem(source, lexicon) | any_of(kept)


# --- reply gates ---------------------------------------------------------------
def hard_rules(source: Column, output: Column, with_lexicon: bool = True) -> list[Rule]:
    source_words = F.greatest(T.count(source, C.WORD), F.lit(1))
    needed = F.greatest(F.lit(2), F.floor(F.lit(0.35) * source_words.cast("double")))
    rules = [
        ("empty", output == ""),
        ("refusal", output.rlike(C.REFUSAL)),
        ("devanagari_remaining", T.devanagari_share(output) > 0.05),
        ("collapsed_length", T.count(output, C.WORD) < needed),
    ]
    if with_lexicon:
        rules.append(("abuse_lexicon_missing", ~lexicon_preserved(source, output)))
    return rules


def hard_check(source: Column, output: Column, with_lexicon: bool = True) -> Column:
    return first_failure(hard_rules(source, output, with_lexicon))


def spike(h: Column, g: Column, delta: float = C.SCORE_DELTA) -> Column:
    return (g >= 0.5) & (g > h + F.lit(delta))


def score_gate(label: Column, h: Column, g: Column, delta: float = C.SCORE_DELTA) -> Column:
    """Abusive rows may not drop, other rows may not spike."""
    dropped = (label == 0) & ~(g >= h - F.lit(delta))
    return first_failure([("abuse_score_drop", dropped), ("abuse_score_spike", (label != 0) & spike(h, g, delta))])


def non_abusive_spike(label: Column, h: Column, g: Column, delta: float = C.SCORE_DELTA) -> Column:
    zero = F.lit(0.0)
    return (label == 1) & spike(F.coalesce(h, zero), F.coalesce(g, zero), delta)


def scores_disagree(label: Column, h: Column, g: Column) -> Column:
    return ((label == 0) & (h < 0.1) & (g < 0.2)) | ((label == 1) & (h > 0.7) & (g > 0.7))


def scorer_agrees(judge_label: Column, g: Column) -> Column:
    return F.when(g >= 0.5, 0).otherwise(1) == judge_label


def resolve_attempts(attempts: DataFrame, key: Sequence[str], delta: float = C.SCORE_DELTA) -> DataFrame:
    """Outcome per row over its replies: first passing one, else last failure.

    ``attempts`` has the key, attempt, label, source, raw, h and g. The gate is
    evaluated once per reply before the shuffle; only one reply text per row
    leaves the map side, through the partial aggregates.
    """
    gated = attempts.withColumn("reply", T.clean_reply(F.col("raw")))
    gated = gated.withColumn("hard", hard_check(F.col("source"), F.col("reply")))
    gated = gated.withColumn(
        "reason",
        F.when(F.col("hard") != "ok", F.col("hard")).otherwise(score_gate(F.col("label"), F.col("h"), F.col("g"), delta)),
    )
    passed = F.when(F.col("reason") == "ok", F.col("attempt"))
    grouped = gated.groupBy(*key).agg(
        F.min(passed).alias("first_ok"),
        F.max("attempt").alias("last_attempt"),
        F.max_by("reason", "attempt").alias("last_reason"),
        F.min_by("reply", passed).alias("ok_reply"),
        F.max_by("reply", "attempt").alias("last_output"),
        F.first("label").alias("label"),
        F.first("h").alias("h"),
        F.min_by("g", passed).alias("ok_g"),
        F.max_by("g", "attempt").alias("last_g"),
    )
    ok = F.col("first_ok").isNotNull()
    g = F.when(ok, F.col("ok_g")).otherwise(F.col("last_g"))
    return grouped.select(
        *key,
        "label",
        F.when(ok, "accepted").otherwise("quarantined").alias("status"),
        F.when(ok, "ok").otherwise(F.col("last_reason")).alias("fail_reason"),
        (F.coalesce("first_ok", "last_attempt") + 1).cast("bigint").alias("attempts"),
        F.when(ok, F.col("ok_reply")).otherwise("").alias("text"),
        F.col("last_output"),
        F.col("h"),
        g.alias("g"),
        (F.col("h") - g).alias("score_delta"),
    )


def released(fail_reason: Column) -> Column:
    """Quarantine rows that may be tried again."""
    r = F.coalesce(fail_reason, F.lit("nan"))
    return F.contains(r, F.lit("Throttl")) | F.startswith(r, F.lit("api_error")) | (r == "abuse_score_drop")


# --- error analysis ------------------------------------------------------------
def error_kind(label: Column, pred: Column) -> Column:
    return F.when(label == pred, "ok").when(label == 0, "fn").otherwise("fp")


def borderline(p: Column) -> Column:
    return (p >= 0.4) & (p <= 0.6)


def error_bucket(label: Column, pred: Column, source: Column, output: Column, h: Column, g: Column) -> Column:
    wrong_label = ((label == 0) & (h < 0.1) & (g < 0.2)) | ((label == 1) & (h > 0.8) & (g > 0.8))
    rules = [
        ("source_label_wrong", wrong_label),
        ("softened_slur", (label == 0) & (source != "") & ~lexicon_preserved(source, output)),
        ("obfuscation", output.rlike(C.OBFUSCATED_TERMS) | (F.contains(output, F.lit(".")) & has_stem(source))),
        ("caste_religious", output.rlike(C.GROUP_TERMS) | source.rlike(C.GROUP_TERMS)),
        ("english_heavy_mix", T.english_heavy(output)),
        ("sarcasm", output.rlike(C.SARCASM_TERMS)),
        ("benign_looking_insult", (label == 0) & (pred == 1)),
        ("false_positive_other", (label == 1) & (pred == 0)),
    ]
    return first_failure(rules, "other")


# --- thread gates --------------------------------------------------------------
def script_matches(script: Column, turns: Column) -> Column:
    """Letters and marker words must fit the declared script."""
    joined = F.array_join(turns, " ")
    dev, lat = T.count(joined, C.DEVANAGARI), T.count(joined, C.LATIN)
    words = F.regexp_extract_all(F.lower(joined), F.lit(C.APOSTROPHE_WORD), F.lit(0))
    n = F.size(words).cast("double")

    def share(lexicon):
        return F.size(F.filter(words, lambda w: w.isin(list(lexicon)))).cast("double") / n

    dev_share = dev.cast("double") / F.greatest(dev + lat, F.lit(1)).cast("double")
    strict, marked = share(C.STRICT_SCRIPT_WORDS), share(C.MARKED_SCRIPT_WORDS)
    return (
        F.when(script == "hindi_devanagari", (dev >= 10) & (dev_share >= 0.85))
        .when((dev > 0) | (n == 0), False)
        .when(script == "english", strict < 0.04)
        .otherwise(marked >= 0.15)
    )


def thread_rules(length, label, script, pair_line, turns: Column, min_chars=2, max_chars=320) -> list[Rule]:
    joined = F.array_join(turns, " ")
    normed = F.transform(turns, T.normalise)
    n = F.size(normed)
    last = F.element_at(normed, -1)
    earlier, later = F.slice(normed, F.lit(1), n - 1), F.slice(normed, F.lit(2), n - 1)
    bare = lambda c: F.trim(c, F.lit(" .\"'!"))
    clean_class = label != "hostile_abuse"
    return [
        ("bad_count", n != length),
        ("refusal", joined.rlike(C.THREAD_REFUSAL)),
        ("turn_len", F.exists(turns, lambda t: (F.length(t) < min_chars) | (F.length(t) > max_chars))),
        ("adjacent_dup", F.exists(F.zip_with(earlier, later, lambda a, b: a == b), lambda x: x)),
        ("last_in_context", F.array_contains(earlier, last)),
        ("pair_line_changed", (F.coalesce(pair_line, F.lit("")) != "") & (bare(last) != bare(T.normalise(pair_line)))),
        ("script", ~script_matches(script, turns)),
        ("profanity_in_clean_class", clean_class & joined.rlike(C.PROFANE_TERMS)),
        ("explicit", clean_class & joined.rlike(C.EXPLICIT_TERMS)),
        ("grooming_sexualised", (label == "predatory_grooming") & joined.rlike(C.CONTACT_TERMS)),
    ]


def basic_thread_rules(label: Column, turns: Column) -> list[Rule]:
    """Checks of the earlier thread generator."""
    context = T.context_turns(turns)
    joined = F.array_join(turns, " ")
    return [
        ("refusal", joined.rlike(C.THREAD_REFUSAL)),
        ("devanagari", joined.rlike(C.DEVANAGARI)),
        ("empty", F.exists(context, lambda t: F.length(t) < 2)),
        ("grooming_sexual", (label == "predatory_grooming") & F.array_join(context, " ").rlike(C.CONTACT_TERMS)),
        ("benign_sexual", (label == "benign") & joined.rlike(C.CONTACT_TERMS)),
    ]


def chat_rules(kind: Column, seed: Column, turns: Column) -> list[Rule]:
    joined = F.array_join(turns, " ")
    wanted = T.normalise(seed)
    marked = lambda t: any_of([F.contains(F.lower(t), F.lit(s)) for s in C.MARKER_SURFACES])
    return [
        ("too_short", F.size(turns) < 3),
        ("refusal", joined.rlike(C.REFUSAL)),
        ("devanagari", joined.rlike(C.DEVANAGARI)),
        ("empty_turn", F.exists(turns, lambda t: F.length(t) < 2)),
        ("seed_missing", (kind == "benign_chat") & ~F.exists(turns, lambda t: T.normalise(t) == wanted)),
        ("seed_not_last", (kind == "abuse_after_smalltalk") & (T.normalise(F.element_at(turns, -1)) != wanted)),
        ("context_slur", F.exists(turns, lambda t: (T.normalise(t) != wanted) & marked(t))),
    ]


# --- live scoring --------------------------------------------------------------
def incoming(is_outgoing: Column, text: Column) -> Column:
    return ~is_outgoing & (F.length(T.strip(text)) >= 5)


def flagged(score: Column, from_fallback: Column, fallback_threshold: float) -> Column:
    return F.when(from_fallback, score >= fallback_threshold).otherwise(score > C.FLAG_ABOVE)


def severity(is_flagged: Column, score: Column) -> Column:
    return F.when(is_flagged, F.when(score >= C.HIGH_FROM, "high").otherwise("medium"))


def abusive_score(results: Column) -> Column:
    """Score out of array<struct<label, score>> whichever class is listed."""
    named = lambda names: F.filter(results, lambda r: F.lower(r["label"]).isin(*names))
    yes, no = named(["abusive", "label_0"]), named(["non-abusive", "label_1"])
    return F.coalesce(F.get(yes, F.lit(0))["score"], 1 - F.get(no, F.lit(0))["score"], F.lit(0.0))
