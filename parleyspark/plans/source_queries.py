"""Sources and sinks over the supplied tables: write a table in a format, read it back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parleyspark.operators import ledger as L
from parleyspark.plans import frames as B
from parleyspark.plans import text_queries as Q
from parleyspark.plans import thread_queries as Th
from parleyspark.plans.registry import query
from parleyspark.session import checkpoint_root, table
from parleyspark.sources import frozen as Z
from parleyspark.sources import readers as R
from parleyspark.sources import sinks as K
from parleyspark.sources.chunks import ChunkedJob


def folder(spark) -> str:
    """Fresh folder for one run's files, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


@query(
    "source_labelled",
    "SELECT 'train' AS split, l.toxic AS label, md5(d.text) AS text_hash, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL GROUP BY ALL",
)
def source_labelled(spark, sf):
    """CSV split with quoted line breaks: gaps dropped, rows numbered."""
    path = folder(spark)
    rows = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("Label")), "doc_id")
    K.append_csv(rows, path, ["Label", "text"])
    d = R.load_labelled(spark, path, "train")
    return d.groupBy("split", "label", F.md5("text").alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("source_row_ids", "SELECT count(*) AS n, count(*) AS distinct_ids, 0::BIGINT AS first, count(*) - 1 AS last FROM labels")
def source_row_ids(spark, sf):
    """Numbers that the CSV loader gives: from 0, without gaps."""
    path = folder(spark)
    K.append_csv(table(spark, sf, "labels").withColumn("text", F.col("doc_id").cast("string")).withColumnRenamed("toxic", "label").repartition(3), path, ["label", "text"])
    number = F.regexp_extract("row_id", r"(\d+)$", 1).cast("bigint")
    return R.load_labelled(spark, path, "val").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("distinct_ids"), F.min(number).alias("first"), F.max(number).alias("last")
    )


_EVENTS = "SELECT user_id, count(*) AS n, max(event_id) AS newest, round(sum(value), 6) AS total FROM events GROUP BY user_id"


@query("source_strict_log", _EVENTS)
def source_strict_log(spark, sf):
    """Keyed JSON lines in two appended deliveries, a bad line being an error."""
    return _log(spark, sf, True)


@query("source_lenient_log", _EVENTS)
def source_lenient_log(spark, sf):
    """The same with corrupt lines between, which are skipped."""
    return _log(spark, sf, False)


def _log(spark, sf, strict):
    path = folder(spark)
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    for part in (0, 1):
        K.append_jsonl(e.filter(F.col("event_id") % 2 == part), path)
    if not strict:
        e.filter("event_id % 10 = 0").select(F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value")).write.mode("append").text(path)
    d = R.read_log(spark, path, "event_id bigint, user_id bigint, value double", "event_id", strict)
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"), F.round(F.sum("value"), 6).alias("total"))


@query("source_threads", f"WITH {B.THREADS} SELECT thread_id, split, length::INTEGER AS length, label, md5(lower(array_to_string(turns, ' '))) AS blob_hash FROM th")
def source_threads(spark, sf):
    """Split files of threads, sorted by id, read back with the lower-cased text."""
    path = folder(spark)
    K.write_splits(B.threads(spark, sf).select("thread_id", "split", F.col("length").cast("int").alias("length"), "label", "turns"), path)
    return R.load_threads(spark, path).select("thread_id", "split", "length", "label", F.md5("_blob").alias("blob_hash"))


@query("source_csv_lines", "SELECT conv_id, count(*) AS n, max(turn)::INTEGER AS last_turn FROM conversations GROUP BY conv_id")
def source_csv_lines(spark, sf):
    """CSV rows held in a text column."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"))
    lines = c.select(F.to_csv(F.struct("conv_id", "turn")).alias("value"))
    d = R.parse_csv_lines(lines, "conv_id bigint, turn int")
    return d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last_turn"))


@query(
    "source_messages",
    f"""WITH m AS (SELECT lang, {Q._SCRUB.replace("html", "text")} AS text FROM documents)
        SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM m WHERE length(text) >= 3 GROUP BY lang""",
)
def source_messages(spark, sf):
    """Single messages with alternate headers; very short ones go."""
    path = folder(spark)
    d = table(spark, sf, "documents").select(F.col("text"), F.col("lang").alias(" Language "), F.lit("1").alias("hate_label"), F.col("source").alias("Source"))
    K.append_csv(d, path, d.columns)
    return R.load_messages(spark, path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("sink_routed", f"WITH {B.RESOLVED} SELECT status, fail_reason, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM outcome GROUP BY ALL")
def sink_routed(spark, sf):
    """Accepted and quarantined rows in one pass, each read back from its folder."""
    from parleyspark.operators import gates as G

    path = folder(spark)
    outcome = G.resolve_attempts(B.replies(spark, sf), ["doc_id", "split"])
    K.write_routed(outcome.select("doc_id", "status", "fail_reason", "attempts"), path)
    parts = [K.read_routed(spark, path, s).withColumn("status", F.lit(s)) for s in ("accepted", "quarantined")]
    return parts[0].unionByName(parts[1]).groupBy("status", "fail_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").cast("bigint").alias("attempts"))


@query("sink_thread_tree", f"WITH {B.THREADS} SELECT length::INTEGER AS length, script, label, split, count(*) AS n FROM th GROUP BY ALL")
def sink_thread_tree(spark, sf):
    """Tree by length, script, label and split; written twice, the old tree is replaced."""
    path = folder(spark)
    rows = B.threads(spark, sf).select("thread_id", "length", "script", "label", "split", "turns")
    for _ in range(2):
        K.write_thread_tree(rows, path)
    d = spark.read.json(path)
    return d.groupBy(F.col("length").cast("int").alias("length"), "script", "label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_ledger",
    f"""WITH {Th._CALLS} SELECT ts_utc::DATE::VARCHAR AS date_utc, job, service, model, count(*)::VARCHAR AS n_calls, sum(i)::BIGINT::VARCHAR AS input_tokens
        FROM us GROUP BY ts_utc::DATE, job, service, model""",
)
def sink_ledger(spark, sf):
    """Daily ledger as CSV without the grand total."""
    path = folder(spark)
    K.write_ledger(L.ledger(Th.calls(spark, sf)), path)
    return R.read_csv(spark, path).select("date_utc", "job", "service", "model", "n_calls", "input_tokens")


@query("sink_append", "SELECT lang, 2 * count(*) AS n FROM documents GROUP BY lang")
def sink_append(spark, sf):
    """Two appended deliveries of CSV rows, a header in each file."""
    path = folder(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang")
    for _ in range(2):
        K.append_csv(d, path, ["doc_id", "lang"])
    return R.read_csv(spark, path, "doc_id bigint, lang string").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_split_errors",
    f"""WITH {B.LABELLED}, p AS (SELECT doc_id, split, label, (CASE WHEN g >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS pred FROM lab)
        SELECT 'scored' AS kind, split, count(*) AS n, sum(pred)::BIGINT AS predicted FROM p GROUP BY split UNION ALL SELECT 'errors', split, count(*), sum(pred)::BIGINT FROM p WHERE label <> pred GROUP BY split""",
)
def sink_split_errors(spark, sf):
    """Scored and wrong rows of each split, read back from their folders."""
    path = folder(spark)
    rows = B.label_scores(spark, sf).select("doc_id", "split", "label", F.when(F.col("g") >= 0.5, 1).otherwise(0).cast("bigint").alias("pred"))
    K.write_split_errors(rows, path, "label", "pred")
    return spark.read.parquet(path).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("predicted"))


@query("left_lookup", "SELECT d.lang, count(*) AS n, count(l.toxic) AS known, coalesce(sum(l.toxic), 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def left_lookup(spark, sf):
    """Labels of documents, NULL for those without."""
    from parleyspark.operators.dedup import attach_left

    d = attach_left(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", ["toxic"])
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("known"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("toxic"))


@query(
    "numbered_key_join",
    "SELECT n.n_name, count(*) AS n FROM documents d JOIN nation n ON n.n_nationkey = TRY_CAST(regexp_extract(d.source, '^src([0-9]+)$', 1) AS BIGINT) GROUP BY n.n_name",
)
def numbered_key_join(spark, sf):
    """Join on the number inside a text id."""
    from parleyspark.operators.dedup import attach_by_number

    d = attach_by_number(table(spark, sf, "documents").select("source"), "source", table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "src")
    return d.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


_FIVE = ", ".join(B.s_unit(f"'c{k}|' || text") for k in range(5))


@query("cached_class_scores", f"WITH s AS (SELECT doc_id, [{_FIVE}] AS p FROM documents) SELECT doc_id, list_position(p, list_max(p)) - 1 AS best, list_max(p) AS top FROM s")
def cached_class_scores(spark, sf):
    """Five class scores for each distinct text; the second half of the table finds those of the first in the cache."""
    from parleyspark.functions.hashing import hash_unit
    from parleyspark.operators.scoring import cached_scores

    path = folder(spark)
    d = table(spark, sf, "documents").select("doc_id", "text")
    scorer = lambda t: F.array(*[hash_unit(F.lit(f"c{k}"), t) for k in range(5)])
    cached_scores(d.filter("doc_id % 2 = 0"), "text", scorer, path)
    scored = cached_scores(d, "text", scorer, path, "p")
    top = F.array_max("p")
    return scored.select("doc_id", (F.array_position("p", top) - 1).cast("int").alias("best"), top.alias("top"))


_CELLS = "length::INTEGER AS length, script, label, split"


@query(
    "frozen_check",
    f"""WITH {B.THREADS}, c AS (SELECT {_CELLS}, count(*) AS n FROM th GROUP BY ALL), f AS (SELECT length, script, label, split FROM c ORDER BY ALL LIMIT 1),
        l AS (SELECT unnest(['all', 'cells']) AS layout)
        SELECT layout, length, script, label, split, n AS rows, n AS found, NOT (layout = 'cells' AND (length, script, label, split) IN (SELECT (length, script, label, split) FROM f)) AS intact FROM c CROSS JOIN l""",
)
def frozen_check(spark, sf):
    """Threads frozen in both layouts; one word is then added to the threads of the tree's first cell, which the check sees."""
    path = folder(spark)
    rows = B.threads(spark, sf).select("thread_id", F.col("length").cast("int").alias("length"), "script", "label", "split", "turns")
    Z.freeze(rows, path)
    first = F.struct(*Z.CELL)
    at = Z.manifest(spark, path).agg(F.min(first).alias("c")).first()["c"]
    schema = spark.createDataFrame([], rows.schema).schema
    flat = spark.read.schema(schema).json(f"{path}/{Z.FLAT}").select(*schema.names)
    if at is not None:
        hit = flat.filter(first == F.struct(*[F.lit(at[c]).cast(flat.schema[c].dataType).alias(c) for c in Z.CELL]))
        changed = hit.withColumn("turns", F.concat("turns", F.array(F.lit("later"))))
        changed.write.mode("overwrite").json("/".join([f"{path}/{Z.TREE}", *[f"_{c}={at[c]}" for c in Z.CELL]]))
    return Z.check(spark, path, schema)


@query("frozen_split", f"WITH {B.THREADS} SELECT thread_id, length::INTEGER AS length, label, md5(array_to_string(turns, chr(10))) AS turns_hash FROM th WHERE split = 'test'")
def frozen_split(spark, sf):
    """The test split of a frozen set, read after the check of its manifest."""
    path = folder(spark)
    rows = B.threads(spark, sf).select("thread_id", F.col("length").cast("int").alias("length"), "script", "label", "split", "turns")
    Z.freeze(rows, path)
    d = Z.read_frozen(spark, path, rows.schema, "test")
    return d.select("thread_id", "length", "label", F.md5(F.array_join("turns", "\n")).alias("turns_hash"))


@query("resumed_chunks", "SELECT doc_id, length(text)::BIGINT AS n_chars, md5(text) AS text_hash FROM documents")
def resumed_chunks(spark, sf):
    """A job over documents in five chunks that stops after the second and is run again."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    work = lambda rows: rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_hash"))
    path = folder(spark)
    for stop in (2, None):
        ChunkedJob(spark, path, "doc_id", chunks=5).run(d, work, stop)
    return ChunkedJob(spark, path, "doc_id").result().drop("chunk")


@query("source_pairs", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, lang, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY ALL")
def source_pairs(spark, sf):
    """Accepted pairs of two splits, a folder each, read together."""
    d = table(spark, sf, "documents").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train"))
    row = {"row_id": F.col("doc_id").cast("string"), "split": F.col("split"), "label": F.lit(1), "text": F.col("text"), "hindi_text": F.col("lang")}
    empty = {c: F.lit(None).cast("string") for c in ("hindi_abuse", "hinglish_abuse", "score_delta", "attempts")}
    rows = d.select(*[c.alias(n) for n, c in (row | empty).items()])
    paths = [f"{folder(spark)}/{split}" for split in ("train", "val")]
    for split, path in zip(("train", "val"), paths, strict=True):
        K.append_csv(rows.filter(F.col("split") == split), path, rows.columns)
    return R.load_pairs(spark, paths).groupBy("split", F.col("hindi_text").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(
    "source_attempts",
    """SELECT CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n, sum(2)::BIGINT AS attempts, count(*) FILTER (event_id % 5 <> 0) AS scored FROM events GROUP BY ALL
        UNION ALL SELECT 'corrupt', count(*), 0, 0 FROM events WHERE event_id % 7 = 0 HAVING count(*) > 0""",
)
def source_attempts(spark, sf):
    """Log with two attempts a row, of which the later counts, scores that are no numbers, and broken lines between."""
    e = table(spark, sf, "events").select("event_id")
    k = F.col("event_id")
    score = F.when(k % 5 == 0, "n/a").otherwise("0.5")
    attempt = lambda n, ok: F.to_json(F.struct(k.cast("string").alias("row_id"), F.lit(n).alias("attempts"), ok.alias("ok"), score.alias("hindi_abuse")))
    broken = F.when(k % 7 == 0, F.concat(F.lit('{"row_id": "'), k.cast("string"), F.lit('", bad')))
    path = folder(spark)
    e.select(F.explode(F.array_compact(F.array(attempt(1, F.lit(False)), broken, F.lit("  "), attempt(2, k % 4 != 0)))).alias("value")).write.text(path)
    rows, bad = R.read_attempts(spark, path)
    good = rows.groupBy(F.when(F.col("ok"), "ok").otherwise("failed").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("attempts").cast("bigint").alias("attempts"), F.count("hindi_abuse").alias("scored")
    )
    zero = F.lit(0).cast("bigint")
    return good.unionByName(bad.filter("corrupt_lines > 0").select(F.lit("corrupt").alias("outcome"), F.col("corrupt_lines").alias("n"), zero.alias("attempts"), zero.alias("scored")))


@query(
    "source_comment_tree",
    f"""WITH c AS (SELECT conv_id, turn, {Q._SCRUB.replace("html", "coalesce(text, '')")} AS text FROM conversations), m AS (SELECT conv_id, min(turn) AS first FROM c GROUP BY conv_id)
        SELECT 'kept' AS kind, CASE WHEN conv_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(length(text))::BIGINT AS chars
        FROM c JOIN m USING (conv_id) WHERE turn > first AND conv_id % 5 <> 0 AND text NOT IN ('', '[deleted]', '[removed]') GROUP BY ALL
        UNION ALL SELECT 'all', 'all', count(*), sum(length(text))::BIGINT FROM c JOIN m USING (conv_id) WHERE turn > first HAVING count(*) > 0""",
)
def source_comment_tree(spark, sf):
    """Conversations as a forum's table: the first turn is the post, each later turn answers the one before."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    c = c.join(c.groupBy("conv_id").agg(F.min("turn").alias("first")), "conv_id")
    post = F.concat(F.lit("p"), F.col("conv_id").cast("string"))
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), t.cast("string"))
    is_post, place = F.col("turn") == F.col("first"), F.col("turn") - F.col("first")
    split = F.when(F.col("conv_id") % 5 == 0, "exclude_lang").when(F.col("conv_id") % 4 == 0, "test").otherwise("train")
    rows = c.select(
        F.when(is_post, F.concat(post, F.lit("-post"))).otherwise(name(F.col("turn"))).alias("info_id"),
        F.when(is_post, "NA").when(place == 1, post).otherwise(name(F.col("turn") - 1)).alias("info_id.parent"), F.col("text").alias("meta_text"),
        split.alias("split"), F.lit("Neutral").alias("annotation_Primary"), F.lit("NA").alias("annotation_Context"),
    )
    path = folder(spark)
    rows.write.option("header", True).option("sep", "\t").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    keep, comments, _ = R.load_comment_tree(spark, path)
    facts = (F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))
    kept = keep.groupBy("split").agg(*facts).select(F.lit("kept").alias("kind"), "split", "n", "chars")
    return kept.unionByName(comments.agg(*facts).filter("n > 0").select(F.lit("all").alias("kind"), F.lit("all").alias("split"), "n", "chars"))


_SIGN = "(conv_id + turn + k) % 4"


@query(
    "source_annotators",
    f"""WITH v AS (SELECT conv_id, coalesce(text, '') AS text, {_SIGN} AS s, k FROM conversations, (SELECT unnest([0, 1, 2]) AS k)),
        a AS (SELECT conv_id, text, avg((s < 2)::INTEGER) AS ab, avg((s = 3)::INTEGER) AS no, avg((s = 1)::INTEGER) AS sex FROM v GROUP BY ALL),
        u AS (SELECT *, {Q._SCRUB.replace("html", "text")} AS said FROM a WHERE NOT ((ab > 0.25 AND ab < 0.5) OR (ab < 0.5 AND no < 0.5)))
        SELECT conv_id, md5(said) AS said_hash, (ab >= 0.5)::INTEGER AS y, (sex >= 0.5)::INTEGER AS y_sex FROM u WHERE said <> ''""",
)
def source_annotators(spark, sf):
    """Three annotators' flags for each turn, as vote shares; unclear turns go."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    sign = (F.col("conv_id") + F.col("turn") + F.col("k")) % 4
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    rows = c.select(
        "conv_id", F.lit("_").alias("prev_agent"), F.lit("_").alias("prev_user"), F.lit("hey").alias("agent"), F.col("text").alias("user"), F.lit("b").alias("bot"),
        flag(sign == 3).alias("is_abuse.1"), flag(sign == 0).alias("is_abuse.-1"), flag(sign == 1).alias("is_abuse.-2"), F.lit(0).alias("is_abuse.-3"),
        flag(sign == 1).alias("type.sex_harassment"),
    )
    path = folder(spark)
    K.append_csv(rows.select(*[F.col(f"`{n}`") for n in rows.columns]), path, [f"`{n}`" for n in rows.columns])
    d = R.load_annotator_votes(spark, path)
    return d.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.md5(F.element_at("turns", -1)).alias("said_hash"), "y", "y_sex")


@query("lookup_all", "SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def lookup_all(spark, sf):
    """Orders by their customer's segment; an order without a customer would fail the query."""
    from parleyspark.operators.dedup import attach_all

    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    d = attach_all(o, table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")
    return d.groupBy("segment").agg(F.sum("orders").cast("bigint").alias("n"))


@query("retry_delays", "SELECT event_id, least(8000.0::DOUBLE, 500.0::DOUBLE * pow(2.0::DOUBLE, event_id % 8)) AS wait_ms FROM events")
def retry_delays(spark, sf):
    """Wait before each event's retry, its number being taken from the id."""
    return table(spark, sf, "events").select("event_id", L.retry_delay(F.col("event_id") % 8 + 1).alias("wait_ms"))


@query("end_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT END AS ended FROM orders")
def end_times(spark, sf):
    """Times inside a status text; a text without one has none."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"))
    text = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("User initiated ("), "t", F.lit(" GMT)"))).otherwise(F.concat(F.lit("running since "), "t"))
    return o.select("o_orderkey", F.unix_timestamp(L.parse_end_time(text)).alias("ended"))


@query(
    "metric_report",
    """WITH m AS (SELECT lang, count(*) AS n, avg(length(text))::DOUBLE AS mean_chars FROM documents WHERE lang IS NOT NULL GROUP BY lang)
        SELECT 'corpus' AS section, lang AS key, 'n' AS metric, n::DOUBLE AS value FROM m UNION ALL SELECT 'corpus', lang, 'mean_chars', round(mean_chars, 6) FROM m""",
)
def metric_report(spark, sf):
    """Metrics by language in long form, written as one report and read back."""
    d = table(spark, sf, "documents").filter("lang IS NOT NULL")
    wide = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    path = folder(spark)
    K.write_report(K.long_metrics(wide, "corpus", "lang"), path)
    return R.read_report(spark, path)


@query("incident_export", f"{Th._LOG} SELECT id, score, severity, seq, row_number() OVER (ORDER BY seq DESC) AS place FROM kept_log")
def incident_export(spark, sf):
    """The capped log as one JSON document, read back with the place of each incident."""
    path = folder(spark)
    doc = K.export_incidents(Th.incident_log(spark, sf), "seq")
    spark.createDataFrame([(doc,)], "value string").write.text(path)
    schema = "incidents array<struct<id string, score double, severity string, seq bigint>>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("d")).select(F.posexplode("d.incidents").alias("at", "i"))
    return rows.select("i.*", (F.col("at") + 1).cast("bigint").alias("place"))
