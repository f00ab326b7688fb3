"""Message stream to incident log.

filter -> suppress -> first delivery -> per-contact window state -> score -> log
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parleyspark import config as C
from parleyspark.functions import text as T
from parleyspark.functions.hashing import contact_name, incident_id
from parleyspark.operators import gates as G
from parleyspark.operators import incidents as I
from parleyspark.operators.recency import most_recent, remembered
from parleyspark.operators.windows import fused_score, rolling_window, window_text
from parleyspark.session import cut_lineage
from parleyspark.sources.versions import Versions

SLOT = ST.StructType(
    [ST.StructField("text", ST.StringType()), ST.StructField("tokens", ST.LongType()), ST.StructField("feats", ST.ArrayType(ST.DoubleType()))]
)
WINDOW = ST.StructType(
    [
        ST.StructField("contact", ST.StringType()),
        ST.StructField("seq", ST.LongType()),
        ST.StructField("text", ST.StringType()),
        ST.StructField("window_text", ST.StringType()),
        ST.StructField("n_slots", ST.LongType()),
        ST.StructField("current_tokens", ST.LongType()),
        ST.StructField("window_tokens", ST.LongType()),
        ST.StructField("use_window", ST.BooleanType()),
        ST.StructField("fallback", ST.DoubleType()),
    ]
)


def use_rocksdb(spark) -> None:
    """State store that the window state needs; keeps state off the heap."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


class RollingWindowProcessor(StatefulProcessor):
    """Keeps at most ``max_slots`` slots per contact in state.

    ``weights`` adds the attention score of the kept slots to every row.
    """

    def __init__(self, max_slots=C.MAX_SLOTS, max_tokens=C.MAX_WINDOW_TOKENS, short_tokens=C.SHORT_TOKENS, weights=None, ttl_ms=None):
        self.max_slots, self.max_tokens, self.short_tokens = max_slots, max_tokens, short_tokens
        self.weights, self.ttl_ms = weights, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getListState("slots", SLOT, self.ttl_ms) if self.ttl_ms else handle.getListState("slots", SLOT)

    def _score(self, slots):
        if self.weights is None:
            return None
        import numpy as np

        from parleyspark.operators.attention import attend

        scale = np.maximum(self.weights.std, 1e-6)
        return attend((np.array([s[2] for s in slots], dtype=float) - self.weights.mean) / scale, self.weights)[0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots = [(s[0], s[1], list(s[2]) if s[2] is not None else None) for s in self.slots.get()]
        # a micro-batch arrives unordered; its size is bounded by the source trigger
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for r in batch.itertuples(index=False):
            feats = list(r.feats) if r.feats is not None else None
            if not slots or slots[-1][0] != r.text:
                slots.append((r.text, int(r.tokens), feats))
            slots = slots[-self.max_slots :]
            while len(slots) > 1 and sum(s[1] for s in slots) > self.max_tokens:
                slots.pop(0)
            out.append(
                (
                    key[0], r.seq, r.text, " ".join(s[0] for s in slots), len(slots), int(r.tokens), sum(s[1] for s in slots),
                    len(slots) > 1 and r.tokens < self.short_tokens, self._score(slots),
                )
            )
        self.slots.put(slots)
        yield pd.DataFrame(out, columns=WINDOW.names)

    def close(self) -> None:
        pass


class FirstDelivery(StatefulProcessor):
    """One row of each key: the first by order of the micro-batch that brings the key.

    State is one flag per key. With ``keep_ms`` a timer drops it so long after the event time of that row.
    """

    def __init__(self, order: str, event_time: str | None = None, keep_ms: int | None = None):
        self.order, self.event_time, self.keep_ms = order, event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", ST.StructType([ST.StructField("yes", ST.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.seen.exists(), None
        for frame in rows:
            if not known:
                least = frame.sort_values(self.order, kind="stable").head(1)
                first = least if first is None or least[self.order].iloc[0] < first[self.order].iloc[0] else first
        if first is not None:
            self.seen.update((True,))
            if self.keep_ms is not None:
                self.handle.registerTimer(int(first[self.event_time].iloc[0].timestamp() * 1000) + self.keep_ms)
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted(messages: DataFrame, suppressed: DataFrame | None = None, watermark: tuple[str, str] | None = None, order: str = "seq") -> DataFrame:
    """Incoming, long enough, not suppressed, first delivery of (contact, text).

    Of rows that repeat inside one micro-batch the first by ``order`` stays. Without a watermark the seen set lives
    forever, as in the original; with one (event time, "10 minutes" and the like) a key is forgotten so long after
    its first row, and rows later than the watermark are left out. State holds a hash of contact and text.
    """
    rows = messages.filter(F.col("text").isNotNull()).filter(G.incoming(F.coalesce("is_outgoing", F.lit(False)), F.col("text")))
    rows = rows.withColumn("contact", contact_name(F.col("contact"), "unknown"))
    if suppressed is not None:
        rows = rows.join(suppressed.select("contact", "text"), ["contact", "text"], "left_anti")
    return first_deliveries(rows, order, watermark)


def first_deliveries(rows: DataFrame, order: str = "seq", watermark: tuple[str, str] | None = None, key: Column | None = None) -> DataFrame:
    """First row of each key of a stream; the key is that of contact and text unless given."""
    keyed = rows.withColumn("_seen", seen_key() if key is None else key)
    event_time, keep_ms = None, None
    if watermark:
        event_time = watermark[0]
        interval = rows.sparkSession.sql(f"SELECT CAST(INTERVAL {watermark[1]} AS INTERVAL DAY TO SECOND)").first()[0]
        keep_ms = int(interval.total_seconds() * 1000)
        keyed = keyed.withWatermark(*watermark)
    return keyed.groupBy("_seen").transformWithStateInPandas(
        statefulProcessor=FirstDelivery(order, event_time, keep_ms), outputStructType=rows.schema, outputMode="Append", timeMode="EventTime" if watermark else "None"
    )


def seen_key() -> Column:
    """Fixed-width key of contact and text."""
    return F.sha2(F.concat_ws("\n", F.length("contact"), "contact", "text"), 256)


def window_state(rows: DataFrame, feats: Column | None = None, **settings) -> DataFrame:
    """Window columns for each message from per-contact state."""
    prepared = rows.select(
        "contact", "seq", "text",
        T.content_token_count(F.col("text")).alias("tokens"),
        (feats if feats is not None else F.lit(None).cast("array<double>")).alias("feats"),
    )
    return prepared.groupBy("contact").transformWithStateInPandas(
        statefulProcessor=RollingWindowProcessor(**settings), outputStructType=WINDOW, outputMode="Append", timeMode="ProcessingTime" if settings.get("ttl_ms") else "None"
    )


def scored(windowed: DataFrame, scorer: Callable[[Column], Column], fallback_threshold: float = 0.5) -> DataFrame:
    """Fused score, flag and severity. ``scorer`` maps text to P(abusive) or NULL on failure."""
    current, window = scorer(F.col("text")), scorer(F.col("window_text"))
    failed = F.col("current").isNull()
    d = windowed.withColumns({"current": current, "windowed": window})
    d = d.withColumn("score", fused_score(F.col("current"), F.col("windowed"), F.col("use_window"), F.col("fallback")))
    d = d.withColumn("flagged", G.flagged(F.col("score"), failed, fallback_threshold))
    return d.withColumn("severity", G.severity(F.col("flagged"), F.col("score")))


def incident_rows(flagged: DataFrame) -> DataFrame:
    contact = F.col("contact")
    return flagged.filter("flagged").select(
        incident_id(contact, F.col("text")).alias("id"), "seq", F.current_timestamp().alias("ts"),
        contact_name(contact, "Unknown chat").alias("contact"), "score", "severity", "text", F.lit(None).cast("string").alias("screenshot"),
    )


def incident_sink(path: str, cap: int = C.INCIDENT_CAP, keep: int = 3):
    """foreachBatch writer: one log version per batch id, of which the last ``keep`` stay.

    A retried batch rewrites its own version from the one before it, so replays
    after a lost executor leave the same log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _deliver(Versions(batch.sparkSession, path, keep), batch, batch_id, cap)

    return write


def _deliver(log: Versions, batch: DataFrame, batch_id: int, cap: int) -> None:
    rows, before = incident_rows(batch), log.read(below=batch_id)
    if before is not None:
        merged = I.merge_into_log(before, rows, "seq", cap)
    else:
        merged = I.incident_log(rows.withColumn("delivery", F.lit(0).cast("bigint")), ["delivery", "seq"], cap)
    log.write(merged, batch_id)


def current_log(spark, path: str) -> DataFrame:
    """The newest version of the log; a log that was never written is an error."""
    log = Versions(spark, path).read()
    if log is None:
        raise FileNotFoundError(f"no incident log in {path}")
    return log


def list_incidents(spark, path: str) -> DataFrame:
    """Incidents with their place, the newest delivery first; at most the cap of the log."""
    newest = W.orderBy(F.desc("delivery"), F.desc("seq"))  # of a capped log
    return current_log(spark, path).withColumn("place", F.row_number().over(newest).cast("bigint"))


def clear_log(spark, path: str) -> None:
    """Empty the log. Batches that follow begin with an empty one; a retried batch before it changes nothing."""
    Versions(spark, path).clear()


# --- windows of remembered contacts ---------------------------------------------------
#: Slots that are carried to the next micro-batch.
CARRIED = "contact string, place bigint, generation string, slots array<struct<text: string, tokens: bigint>>"


def observe(batch: DataFrame, carried: DataFrame | None, batch_id: int, capacity: int = C.MAX_CONTACTS, **limits) -> tuple[DataFrame, DataFrame]:
    """(windows, carried) of one micro-batch (contact, seq, text): its window columns, and what the next one needs.

    Only the ``capacity`` most recent contacts over all batches are remembered; one that comes back later begins
    anew. So what is carried is bounded by ``capacity`` contacts of a few slots, whatever the number of contacts.
    """
    rows = cut_lineage(batch.select("contact", "seq", "text", F.lit(batch_id).cast("bigint").alias("delivery")))
    found = remembered(rows, "contact", ["delivery", "seq"], capacity, carried=carried).select("contact", "seq", "kept_history", "generation")
    found = cut_lineage(found)
    messages = rows.join(found, ["contact", "seq"]).withColumn("tokens", T.content_token_count(F.col("text")))
    start = rows.agg(F.min("seq")).scalar()
    messages = messages.withColumn("_at", F.col("seq") - start)
    if carried is not None:  # slots go ahead of the batch as messages do, under places below zero
        again = carried.select("contact", "generation", F.posexplode("slots").alias("_k", "_s"), F.size("slots").alias("_n"))
        again = again.select("contact", "generation", (F.col("_k") - F.col("_n")).cast("bigint").alias("_at"), "_s.text", "_s.tokens")
        messages = messages.unionByName(again, allowMissingColumns=True)
    chats = messages.withColumn("_chat", F.struct("contact", "generation"))
    windowed = rolling_window(chats, "_chat", "_at", "text", "tokens", **limits)
    windowed = cut_lineage(windowed.withColumn("slots", F.transform("slots", lambda s: F.struct(s["text"].alias("text"), s["tokens"].alias("tokens")))))
    recent = most_recent(messages.filter("_at >= 0"), "contact", ["delivery", "seq"], capacity=capacity, carried=carried)
    last = windowed.groupBy("contact", "generation").agg(F.max_by("slots", "_at").alias("slots"))
    after = recent.join(last, ["contact", "generation"]).select("contact", "place", "generation", "slots")
    out = windowed.filter("_at >= 0").select(
        "contact", "seq", "text", window_text(F.col("slots"), "text").alias("window_text"), "n_slots", F.col("tokens").alias("current_tokens"),
        "window_tokens", "use_window", "kept_history", "generation",
    )
    return out, after


def remembering_sink(path: str, score: Callable[[DataFrame], DataFrame] | None = None, cap: int = C.INCIDENT_CAP, keep: int = 3, capacity: int = C.MAX_CONTACTS, **limits):
    """foreachBatch writer: windows of remembered contacts, and with ``score`` the incident log.

    Below ``path`` lie ``windows/batch=N``, the versions of ``carried``, and those of ``log``. Each batch starts from
    the versions before it and overwrites its own, so a retried batch leaves what one run would.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = Versions(spark, f"{path}/carried", keep)
        windows, after = observe(batch, state.read(below=batch_id), batch_id, capacity, **limits)
        windows.write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")
        state.write(after, batch_id)
        if score is not None:
            kept = spark.read.schema(windows.schema).parquet(f"{path}/windows/batch={batch_id}")
            _deliver(Versions(spark, f"{path}/log", keep), score(kept), batch_id, cap)

    return write


def run_available(scored_stream: DataFrame, path: str, checkpoint: str, cap: int = C.INCIDENT_CAP):
    """Process what is there and stop; the checkpoint makes the next run resume."""
    return (
        scored_stream.writeStream.foreachBatch(incident_sink(path, cap))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
