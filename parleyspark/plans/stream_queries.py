"""The live path as real streams over the supplied tables.

Each query reads a table as a file stream, runs it to the end with
``availableNow`` and returns what the sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parleyspark.functions.hashing import hash_unit, stable_int
from parleyspark.plans import thread_queries as Th
from parleyspark.plans.registry import query
from parleyspark.session import checkpoint_root, cut_lineage, table
from parleyspark.streaming import live


def table_stream(spark, sf, name):
    """One table of the folder as a stream, be it one file or a folder of parts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    stream = spark.readStream.schema(table(spark, sf, name).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(f"{sf}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # a stream reads folders only


def run_folder(spark) -> str:
    """Fresh folder for one run's sink and progress, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def run_to_table(stream, folder):
    """Append a stream to parquet until its input is used up, then read it."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def admitted_stream(spark, sf):
    t = table_stream(spark, sf, "conversations")
    rows = t.select(
        F.col("conv_id").cast("string").alias("contact"), "text", (F.col("role") == "system").alias("is_outgoing"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )
    suppressed = table(spark, sf, "conversations").filter(Th._SUPPRESSED).select(F.col("conv_id").cast("string").alias("contact"), "text")
    return live.admitted(rows, suppressed)


@query(
    "stream_window_state",
    f"""WITH inc AS (SELECT * FROM conversations WHERE role <> 'system' AND length({Th.B.s_strip('text')}) >= 5 AND NOT ({Th._SUPPRESSED})
        QUALIFY row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) = 1), {Th._s_window(1000, 60, 'inc')}
        SELECT conv_id::VARCHAR AS contact, conv_id * 1000 + turn AS seq, current_tokens, slots AS n_slots, window_tokens, use_window, md5(window_text) AS window_hash FROM wn""",
)
def stream_window_state(spark, sf):
    live.use_rocksdb(spark)
    w = live.window_state(admitted_stream(spark, sf), max_tokens=1000, short_tokens=60)
    out = run_to_table(w, run_folder(spark))
    return out.select("contact", "seq", "current_tokens", "n_slots", "window_tokens", "use_window", F.md5("window_text").alias("window_hash"))


@query("stream_incidents", f"{Th._LOG} SELECT id, conv_id::VARCHAR AS contact, score, severity, seq FROM kept_log")
def stream_incidents(spark, sf):
    """Filter, suppress, dedup, window state, fusion, severity, capped log."""
    live.use_rocksdb(spark)
    w = live.window_state(admitted_stream(spark, sf), max_tokens=1000, short_tokens=60)
    w = w.withColumn("fallback", hash_unit(F.lit("kv"), F.col("text")))
    failed = stable_int(F.lit("fail"), F.col("text")) % 20 == 0
    scored = live.scored(w, lambda t: F.when(~failed, hash_unit(F.lit("m"), t)), 0.6)
    folder = run_folder(spark)
    live.run_available(scored, f"{folder}/log", f"{folder}/progress", cap=100).awaitTermination()
    return live.current_log(spark, f"{folder}/log").select("id", "contact", "score", "severity", "seq")


def in_parts(df, order, parts, folder):
    """The rows as files of a folder, one for each stretch of the order, to be read as so many micro-batches."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = -(-((high or 0) - (low or 0) + 1) // parts)
    for k in range(parts):  # one write after the other, as streams read files by their time
        at = (low or 0) + k * width
        df.filter((F.col(order) >= at) & (F.col(order) < at + width)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query(
    "stream_contact_eviction",
    """WITH e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
        d AS (SELECT e.event_id, e.user_id, e.prev, (SELECT count(DISTINCT o.user_id) FROM events o WHERE o.event_id > e.prev AND o.event_id < e.event_id) AS between_users FROM e)
        SELECT user_id::VARCHAR AS contact, count(*) AS n_messages, count(*) FILTER (prev IS NOT NULL AND between_users < 24) AS kept,
            count(*) FILTER (prev IS NULL OR between_users >= 24) AS generations FROM d GROUP BY user_id""",
)
def stream_contact_eviction(spark, sf):
    """Five micro-batches of messages; contacts beyond the 24 most recent are forgotten and begin anew."""
    folder = run_folder(spark)
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("contact"), F.col("event_type").alias("text"), F.col("event_id").alias("seq"))
    stream = in_parts(e, "seq", 5, folder)
    sink = live.remembering_sink(f"{folder}/out")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    w = spark.read.parquet(f"{folder}/out/windows")
    return w.groupBy("contact").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if("kept_history").alias("kept"), F.countDistinct("generation").alias("generations"))


_CLEARED = Th._LOG.replace("FROM fl WHERE flagged)", "FROM fl WHERE flagged AND conv_id % 3 = 2)")


@query("incident_clear", f"{_CLEARED} SELECT id, conv_id::VARCHAR AS contact, score, severity, seq FROM kept_log")
def incident_clear(spark, sf):
    """Three deliveries to the log, which is cleared after the second; what is listed then."""
    path = f"{run_folder(spark)}/log"
    hits = cut_lineage(Th.live_hits(spark, sf).withColumns({"flagged": F.lit(True), "contact": F.col("conv_id").cast("string")}))
    sink = live.incident_sink(path, cap=100)
    for k in range(3):
        if k == 2:
            live.clear_log(spark, path)
        sink(hits.filter(F.col("conv_id") % 3 == k), k)
    return live.list_incidents(spark, path).select("id", "contact", "score", "severity", "seq")


@query("stream_seen_dedup", "SELECT user_id, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY user_id")
def stream_seen_dedup(spark, sf):
    live.use_rocksdb(spark)
    e = table_stream(spark, sf, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    seen = run_to_table(e, run_folder(spark))
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_kinds"))


@query("stream_first_delivery", "SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY user_id, event_type")
def stream_first_delivery(spark, sf):
    """The first event of each user and type over four micro-batches, whatever their order inside one."""
    live.use_rocksdb(spark)
    folder = run_folder(spark)
    e = in_parts(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "event_id", 4, folder)
    key = F.concat_ws("\n", F.col("user_id").cast("string"), "event_type")
    seen = run_to_table(live.first_deliveries(e, "event_id", key=key), folder)
    return seen.select("user_id", "event_type", F.col("event_id").alias("first_event"))
