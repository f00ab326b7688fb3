"""Lexicons of any size, joined as tables.

A small lexicon is a handful of patterns in a plan (``text.stem_hit``, ``text.token_matches``). A large one meets the
vocabulary of the texts instead: each distinct token is turned into the few entries that could match it, and these
are joined by equality. Matching tokens then go back to their texts. A token that most texts hold is one row of the
vocabulary, and the way back is a broadcast only if few tokens match, else a join of written tables, whose hot keys
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import text as T
from parleyspark.session import cut_lineage

#: A stem of so many letters may have up to two more letters after it; a marker surface of so many any ending.
STEM_LETTERS, STEM_MORE, SURFACE_LETTERS = 4, 2, 5


def attach_found(left: DataFrame, found: DataFrame, on: str, limit: int = 200_000) -> DataFrame:
    """Inner join with a written table that is broadcast only if it has at most ``limit`` rows."""
    return left.join(F.broadcast(found) if found.limit(limit + 1).count() <= limit else found, on)


def _vocabulary(tokens: DataFrame, keys: Column) -> DataFrame:
    return tokens.select("token").distinct().select("token", F.explode(keys).alias("entry"))


def stem_matches(df: DataFrame, key: str, text: str, stems: DataFrame) -> DataFrame:
    """Distinct (key, stem): a content token equals the stem, or is one of four letters or more with at most two after it.

    ``stems``: a column ``stem``; nulls, blanks and repeats do not count. Null texts match nothing.
    """
    tokens = cut_lineage(df.select(key, F.explode(F.array_distinct(T.content_tokens(T.tokens(F.col(text))))).alias("token")))
    n = F.length("token")
    shorter = [F.when(n - k >= STEM_LETTERS, F.substring(F.col("token"), F.lit(1), n - k)) for k in range(1, STEM_MORE + 1)]
    entries = stems.select(F.col("stem").alias("entry")).filter("entry <> ''").distinct()
    found = _vocabulary(tokens, F.array_compact(F.array("token", *shorter))).join(entries, "entry")
    found = cut_lineage(found.select("token", F.col("entry").alias("stem")))
    return attach_found(tokens, found, "token").select(key, "stem").distinct()


def marker_matches(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, position, stem, surface): the token at a 0-based position carries a surface of the stem.

    A folded token carries a surface that it equals, or that has five letters or more and begins it. ``lexicon``:
    (stem, surface) rows. A token with several surfaces has a row for each.
    """
    parts = F.filter(F.split(text, C.SPACE_RUN), lambda t: t != "")
    tokens = df.select(key, F.posexplode(parts).alias("position", "raw"))
    tokens = cut_lineage(tokens.select(key, "position", F.regexp_replace(T.fold_obfuscation(F.col("raw")), C.NOT_WORD_CHAR, "").alias("token")).filter("token <> ''"))
    entries = cut_lineage(lexicon.select("stem", "surface", F.col("surface").alias("entry")).filter("entry <> ''").distinct())
    longest = F.lit(entries.agg(F.max(F.length("entry"))).first()[0] or 0)
    ends = F.least(F.length("token") - 1, longest)
    prefixes = F.when(ends >= SURFACE_LETTERS, F.transform(F.sequence(F.lit(SURFACE_LETTERS), ends), lambda k: F.substring(F.col("token"), F.lit(1), k)))
    keys = F.concat(F.array("token"), F.coalesce(prefixes, F.array().cast("array<string>")))
    found = cut_lineage(_vocabulary(tokens, keys).join(entries, "entry").select("token", "stem", "surface"))
    return attach_found(tokens, found, "token").select(key, "position", "stem", "surface")


def lexicon_table(rows: DataFrame, kind: str) -> DataFrame:
    """(stem, surface, tier) of one kind of a lexicon table (kind, stem, surfaces, tier)."""
    return rows.filter(F.col("kind") == kind).select("stem", F.explode("surfaces").alias("surface"), F.coalesce("tier", F.lit("mild")).alias("tier"))
