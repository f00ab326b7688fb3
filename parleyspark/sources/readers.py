"""Readers for corpora, logs, threads, comment trees and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parleyspark import config as C
from parleyspark.functions import text as T
from parleyspark.operators.dedup import last_wins

PAIR = (
    "row_id string, split string, label int, text string, hindi_text string, hindi_abuse double, "
    "hinglish_abuse double, score_delta double, attempts int"
)
THREAD = (
    "thread_id string, split string, length int, n_context int, script string, label string, label_id int, subtype string, "
    "topic string, audience string, target_gender string, child_age int, pair_id string, speakers array<string>, "
    "turns array<string>, last_turn string, source string"
)
ATTEMPT = (
    "row_id string, split string, label int, hindi_text string, hindi_abuse string, hinglish_abuse string, "
    "score_delta string, attempts int, fail_reason string, ok boolean, last_output string"
)
CALL = (
    "ts_utc timestamp, job string, service string, model string, input_tokens bigint, output_tokens bigint, "
    "usd_estimated double, request_id string, ok boolean, notes string"
)
MESSAGE = "contact string, text string, is_outgoing boolean, seq bigint"
LEXICON = "kind string, stem string, surfaces array<string>, tier string"


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with quoted line breaks; all columns are text without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (reader.schema(schema) if schema else reader).csv(paths)


def resolve_columns(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Select columns by trimmed, case-insensitive header with alternates."""
    known = {c.strip().lower(): c for c in df.columns}
    picks = []
    for out, names in wanted.items():
        found = next((known[n.strip().lower()] for n in names if n.strip().lower() in known), None)
        if found is None:
            raise KeyError(f"none of {list(names)} in {df.columns}")
        picks.append(F.col(f"`{found}`").alias(out))
    return df.select(*picks)


def file_order() -> Column:
    """Total order of rows inside files: file, split offset, row in split."""
    return F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")
    )


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """0-based number in file order from a ``file_order`` column.

    Only one count per file split crosses a window; rows never sort globally.
    """
    keys = [F.col(f"{order}.f").alias("_f"), F.col(f"{order}.b").alias("_b")]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(f"{order}.i").alias("_first"))
    before = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = df.withColumns({"_f": F.col(f"{order}.f"), "_b": F.col(f"{order}.b")}).join(offsets, ["_f", "_b"])
    inside = F.row_number().over(W.partitionBy("_f", "_b").orderBy(F.col(f"{order}.i")))
    return joined.withColumn("ordinal", F.col("_off") + inside - 1).drop("_f", "_b", "_n", "_first", "_off")


def load_labelled(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Raw labelled split: rows with label and text, numbered after dropping gaps."""
    raw = resolve_columns(read_csv(spark, path).withColumn("_ord", file_order()), {"label": ["label"], "text": ["text"], "_ord": ["_ord"]})
    rows = raw.dropna(subset=["label", "text"]).withColumn("label", F.col("label").try_cast("double").cast("int"))
    numbered = number_rows(rows, "_ord")
    row_id = F.concat(F.lit(f"{split}-"), F.col("ordinal").cast("string"))
    return numbered.select(row_id.alias("row_id"), F.lit(split).alias("split"), "label", "text")


def load_pairs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Accepted pairs of one or more splits; missing text becomes empty."""
    return read_csv(spark, paths, PAIR).withColumn("text", F.coalesce("text", F.lit("")))


def read_log(spark: SparkSession, path: str, schema: str, key: str, strict: bool) -> DataFrame:
    """Keyed JSONL log, newest record per key; strict fails on a bad line."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    rows = reader.json(path).withColumn("_ord", file_order())
    if not strict:
        rows = rows.filter(F.col(key).isNotNull())
    return last_wins(rows, [key], "_ord").drop("_ord")


def read_attempts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attempt log: last outcome per row with numeric scores, and the bad-line count."""
    lines = spark.read.text(path).withColumn("_ord", file_order()).filter(T.strip(F.col("value")) != "")
    schema = ATTEMPT + ", _corrupt_record string"
    raw = lines.select("_ord", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("_ord", "r.*")
    bad = raw.agg(F.count("_corrupt_record").alias("corrupt_lines"))
    good = last_wins(raw.filter("_corrupt_record IS NULL AND row_id IS NOT NULL"), ["row_id"], "_ord")
    numeric = {c: F.col(c).try_cast("double") for c in ("hindi_abuse", "hinglish_abuse", "score_delta")}
    return good.drop("_corrupt_record", "_ord").withColumns(numeric), bad


def load_threads(spark: SparkSession, path: str) -> DataFrame:
    """Threads with the lower-cased text used by the substring filter."""
    rows = spark.read.schema(THREAD).json(path)
    return rows.withColumn("_blob", F.lower(F.array_join("turns", " ")))


def load_comment_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """TSV of a forum: (rows to evaluate, all comments, posts)."""
    raw = resolve_columns(
        read_csv(spark, path, sep="\t").withColumn("_ord", file_order()),
        {
            "id": ["info_id"], "parent": ["info_id.parent"], "text": ["meta_text"], "split": ["split"],
            "primary": ["annotation_Primary"], "context": ["annotation_Context"], "_ord": ["_ord"],
        },
    ).withColumn("text", T.scrub(F.coalesce("text", F.lit(""))))
    from parleyspark.operators.threads import post_texts

    is_post = F.col("id").rlike("-(title|post)$")
    base = raw.filter(is_post).withColumn("base", F.regexp_replace("id", "-[^-]*$", ""))
    posts = post_texts(base, "base", "_ord", "text")
    parent = F.when(F.col("parent") != "NA", F.col("parent"))
    comments = raw.filter(~is_post).withColumn("parent", parent).drop("_ord")
    keep = ~F.startswith("split", F.lit("exclude")) & ~F.col("text").isin("", "[deleted]", "[removed]")
    return comments.filter(keep), comments, posts


def load_annotator_votes(spark: SparkSession, path: str) -> DataFrame:
    """Vote shares per conversation turn; unclear turns are dropped."""
    keys = ["conv_id", "prev_agent", "prev_user", "agent", "user"]
    flags = {"a0": "is_abuse.1", "a1": "is_abuse.-1", "a2": "is_abuse.-2", "a3": "is_abuse.-3", "sex": "type.sex_harassment"}
    raw = resolve_columns(read_csv(spark, path), {**{k: [k] for k in keys}, "bot": ["bot"], **{k: [v] for k, v in flags.items()}})
    flag = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    any_abuse = F.when((flag("a1") != 0) | (flag("a2") != 0) | (flag("a3") != 0), 1.0).otherwise(0.0)
    votes = raw.groupBy(*keys).agg(
        F.avg(any_abuse).alias("ab"), F.avg(flag("a0").cast("double")).alias("not_ab"), F.avg(flag("sex").cast("double")).alias("sex"),
        F.min("bot").alias("bot"),
    )
    ab = F.col("ab")
    unclear = ((ab > 0.25) & (ab < 0.5)) | ((ab < 0.5) & (F.col("not_ab") < 0.5))
    user = T.scrub(F.coalesce("user", F.lit("")))
    context = F.filter(F.array("prev_agent", "prev_user", "agent"), lambda x: x.isNotNull() & (x != "") & (T.strip(x) != "_"))
    turns = F.concat(F.transform(context, T.scrub), F.array(user))
    return votes.filter(~unclear).filter(user != "").select(
        "conv_id", turns.alias("turns"), (ab >= 0.5).cast("int").alias("y"), (F.col("sex") >= 0.5).cast("int").alias("y_sex"), "bot"
    )


def load_messages(spark: SparkSession, path: str) -> DataFrame:
    """Single labelled messages; very short ones are dropped."""
    raw = resolve_columns(
        read_csv(spark, path), {"text": ["text"], "lang": ["language"], "y": ["hate_label"], "source": ["source"]}
    ).withColumns({"text": T.scrub(F.coalesce("text", F.lit(""))), "y": F.col("y").try_cast("int")})
    return raw.filter(F.length("text") >= 3)


def parse_csv_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """CSV rows held in a text column."""
    return lines.select(F.from_csv(column, schema).alias("r")).select("r.*")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows (section, key, metric, value) of a report, which is one JSON document."""
    schema = "metrics array<struct<section string, key string, metric string, value double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("metrics"))


def read_message_stream(spark: SparkSession, path: str, schema: str = MESSAGE, files_per_trigger: int = 100) -> DataFrame:
    """Message stream from JSON files; the first micro-batch is the snapshot."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def load_lexicon(spark: SparkSession, path: str, kind: str, max_rows: int = 5000) -> tuple[C.Lexicon, ...]:
    """Configuration table as literals. Refuses a table too large to be one."""
    rows = spark.read.schema(LEXICON).json(path).filter(F.col("kind") == kind).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"lexicon {kind!r} has more than {max_rows} rows; join it as a table instead")
    return tuple(C.Lexicon(r["stem"], tuple(r["surfaces"]), r["tier"] or "mild") for r in rows)
