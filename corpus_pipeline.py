"""From raw documents to packed training sequences: quality rules, line dedup, near dedup, source mix, packing.

Defined results on odd input are those of the operators; besides, near dedup takes rows with the same doc_id
as one document, of which the row with the least text hash stays; rows without an id are told apart by text. n_chars follows the text that line dedup
leaves. Near dedup links texts whose SimHash fingerprints differ in two bits at most, as op3 does, and those whose sets of
five-word shingles have Jaccard similarity 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parleyspark.llm import adaptive_rules, balance, line_runs, packing, shingle_sets, simhash
from parleyspark.llm.common import keep, unused
from parleyspark.llm.graph import components
from parleyspark.llm.queries import tokenizer
from parleyspark.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds."""
    clashing = [c for c in docs.columns if c.lower() in adaptive_rules.ADDED]
    own = dict(zip(clashing, unused(docs, *[f"own_{c}" for c in clashing]), strict=True))
    judged = adaptive_rules.adaptive_rules(docs.withColumnsRenamed(own)).where("kept")
    return judged.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that larger documents of three or more hold."""
    _, _, kept = unused(docs, "line_count", "dropped_count", "kept_text")
    out = line_runs.dedup_lines(docs)
    changed = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component over links of both kinds: fingerprints (`simhash`), then similar sets.

    Each kind gives its components as links to their least document, so those that both kinds join are one.
    The join and the window share their key, so texts move once.
    """
    name, key, rank = unused(docs, "_gone", "_key", "_rank")
    # documents without an id get one from their text, above all others
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(2**62))
    keyed = docs.withColumn(key, own)
    found = simhash.near_duplicates(keyed, doc_id=key).select("doc_id", "component_id")
    found = found.unionByName(shingle_sets.near_copies(keyed, doc_id=key))
    links = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    gone = keep(components(links).where("node <> root").select(F.col("node").alias(name)))
    first = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    left = keyed.join(gone, keyed[key] == gone[name], "left_anti")
    return left.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    *_, copies = unused(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    (each,) = unused(docs, "_copy")
    mixed = balance.mix(docs)
    return mixed.withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in sequences."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: The rounding of the mix and the packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
