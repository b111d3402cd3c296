"""Structured Streaming forms of the append-only parts."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..functions.policy import with_policy
from ..operators.ingest import recursive_chunks
from ..operators.questions import keep_first, not_asked_before
from ..sources.text_files import with_profile


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append", name: str | None = None) -> None:
    """Process everything there is, one micro-batch at a time, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    writer.foreachBatch(each_batch).start().awaitTermination()


def ingest_stream(files: DataFrame) -> DataFrame:
    """Sources with their content hash. ``files``: name, path, content. Keeps no state: the
    writers below drop what their table already holds."""
    return with_profile(files).drop("modified_at")


#: What is written is cut into so many buckets by its key, so that a batch looks only at those of its own keys.
BUCKETS = 256


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def of_other_batches(batch: DataFrame, batch_id: int, path: str, key: str, fields: str, held_as: str | None = None) -> DataFrame:
    """What other batches wrote below ``path`` in the buckets of this batch's keys, nothing before the first one.

    What this batch wrote before a restart is no history. ``held_as``: the key's name in the table.
    """
    spark = batch.sparkSession
    schema = f"{fields}, bucket int, batch long"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema).drop("batch", "bucket")
    own = [r[0] for r in batch.select(_bucket(key).alias("b")).distinct().collect()]  # BUCKETS at most
    return spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(own) & (F.col("batch") != batch_id)).drop("batch", "bucket")


def _append(rows: DataFrame, batch_id: int, path: str, key: str) -> None:
    """A batch id is written once, also after a restart. Row groups carry Bloom filters of the key."""
    rows.withColumn("bucket", _bucket(key)).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch", "bucket").option(
        "partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def new_sources(batch: DataFrame, batch_id: int, path: str, held_as: str) -> DataFrame:
    """One source for each content hash that the table at ``path`` doesn't hold yet in its column ``held_as``."""
    held = of_other_batches(batch, batch_id, path, "sha256", f"{held_as} string").select(F.col(held_as).alias("sha256"))
    return batch.dropDuplicates(["sha256"]).join(held, "sha256", "left_anti")


def write_new_sources(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for ``ingest_stream``: each content once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _append(new_sources(batch, batch_id, path, "sha256"), batch_id, path, "sha256")
    return write


def write_new_chunks(path: str, chunker=recursive_chunks) -> Callable[[DataFrame, int], None]:
    """Batch writer for ``ingest_stream``: the chunks of each content once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _append(chunker(new_sources(batch, batch_id, path, "source_sha256")), batch_id, path, "source_sha256")
    return write


def tagged_messages(messages: DataFrame, text: str, purpose: str = "user_query") -> DataFrame:
    """Stateless policy tagging of a message stream."""
    return with_policy(messages, text, purpose)


def throughput_windows(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes", session: str = "session_id") -> DataFrame:
    """Token counts per session and event-time window; rows behind the watermark are dropped. ``late`` is None where the events have their watermark already."""
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    counted = (events.withWatermark("ts", late) if late else events).groupBy(session, F.window("ts", width)).agg(
        F.count_if(F.col("kind") == "token").alias("tokens"))
    return counted.select(session, F.col("window.start").alias("start"), "tokens", (F.col("tokens") / seconds).alias("tokens_per_second"))


def activity_windows(events: DataFrame, kind: str = "tumbling", late: str = "10 minutes", session: str = "session_id") -> DataFrame:
    """Session events per tumbling day, sliding six hours of a day, or half-hour session gap."""
    window = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "1 day", "6 hours"),
              "session": F.session_window("ts", "30 minutes")}[kind]
    out = events.withWatermark("ts", late).groupBy(session, window.alias("w")).agg(F.count("*").alias("events"))
    return out.select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators drop because they are behind the watermark, by query name.

    Operators that sum rows up before they look at the watermark count sums; put
    ``on_time`` ahead of them to count rows.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self._names: dict[str, str] = {}
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        name = event.progress.name or str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended.setdefault(self._names.get(str(event.id), str(event.id)), threading.Event()).set()

    def of(self, name: str, wait: float = 60) -> int:
        """Rows dropped by a query that has ended; waits for its last events."""
        self._ended.setdefault(name, threading.Event()).wait(wait)
        return self.dropped.get(name, 0)


def on_time(events: DataFrame, late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Events that aren't behind the watermark, each (key, ts) once. Rows behind it are dropped one by one, so that they can be counted.

    The watermark that drops rows of a micro-batch is the one that the batch before it ran with.
    """
    return events.withWatermark("ts", late).dropDuplicates([key, "ts"])


ANSWER = "session_id string, answer string, tokens long"


class _Assembly(StatefulProcessor):
    """One session's events, held back until the watermark has passed them and then taken in order of time and sequence."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string, text string")
        self.parts = handle.getListState("parts", "text string")
        self.tokens = handle.getValueState("tokens", "n long, newest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for batch in rows:
            at = batch["ts"].map(lambda t: int(t.timestamp() * 1000))
            self.waiting.appendList(list(zip(at.tolist(), batch["seq"].astype("int64").tolist(), batch["kind"].tolist(), [None if pd.isna(x) else x for x in batch["text"]], strict=True)))
            for t in sorted(set(at.tolist())):
                self.handle.registerTimer(max(t, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in waiting if r[0] <= mark], [r for r in waiting if r[0] > mark]
        parts = [r[0] for r in self.parts.get()]
        tokens, newest = tuple(self.tokens.get()) if self.tokens.exists() else (0, 0)
        finished = []
        for at, _, kind, text in due:
            newest = at
            if kind == "token":
                parts.append(text or "")
                tokens += 1
            elif kind == "replace":
                parts = [text or ""]
            elif kind == "error":
                parts, tokens = [], 0
            elif kind == "done":
                finished.append((key[0], "".join(parts), tokens))
                parts, tokens = [], 0
        if not due and parts and mark >= newest + self.idle:  # abandoned
            parts, tokens = [], 0
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if parts:
                self.handle.registerTimer(newest + self.idle)
        if parts:
            self.parts.put([(p,) for p in parts])
            self.tokens.update((tokens, newest))
        else:
            self.parts.clear()
            self.tokens.clear()
        if finished:
            yield pd.DataFrame(finished, columns=["session_id", "answer", "tokens"])

    def close(self) -> None:
        pass


def assemble_answers(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Finished answers per session from token, replace, error and done events, in order of event time.

    Tokens append, a replacement starts over, an error discards, done emits. An event waits
    in a session's list state until the watermark passes its time (a timer), so events that come
    in a later micro-batch than their successors, by up to ``late``, still take their
    place; those behind the watermark are dropped. A session without a finish is
    given up ``idle`` after its last event. Needs the RocksDB state store, which is set here.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return events.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Assembly(wait), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")


def assembled_batch(events: DataFrame) -> DataFrame:
    """Batch twin for sessions with one answer: tokens after the last replacement or error."""
    w_last = events.groupBy("session_id").agg(
        F.max(F.when(F.col("kind").isin("replace", "error"), F.col("seq"))).alias("cut_at"),
        F.max(F.when(F.col("kind") == "error", F.col("seq"))).alias("error_at"), F.max(F.when(F.col("kind") == "done", F.col("seq"))).alias("done_at"))
    rows = events.join(w_last.filter("done_at is not null"), "session_id")
    live = (F.col("seq") < F.col("done_at"))
    text = F.col("kind").isin("token", "replace") & live & (F.col("seq") >= F.coalesce("cut_at", F.lit(-1)))
    counted = (F.col("kind") == "token") & live & (F.col("seq") > F.coalesce("error_at", F.lit(-1)))
    return rows.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text, F.struct("seq", "text")))), lambda r: r["text"]), "").alias("answer"),
        F.count_if(counted).alias("tokens"))


def reject_asked(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that accepts questions unlike all accepted so far.

    Accepted questions are a table, not task state, so a dataset of any size is
    compared by a distributed join; only the buckets of the batch's datasets are read. Batches: dataset_id, question_id, seq, question.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        key = batch.schema["dataset_id"].dataType.simpleString()
        accepted = of_other_batches(batch, batch_id, path, "dataset_id", f"dataset_id {key}, question string")
        fresh = batch if accepted.isEmpty() else not_asked_before(batch, accepted)
        _append(keep_first(fresh), batch_id, path, "dataset_id")
    return write
