"""Incremental reply intake (ST1): new reply files are parsed, finished ids are dropped, open ones
are offered again after a while.

What is known of an id is keyed state of the stream (``transformWithState``): whether it is done and how
often it was tried. An epoch therefore reads its own files alone and never the earlier results. An id
without an output stays open: a timer offers it for another prompt after ``retry_seconds``, until it
is done or was tried ``max_tries`` times. Finished ids leave the state after ``forget_seconds``. Timers
fire in a query that goes on running; one that ends with its files fires them in its next epoch.

Parsing, shuffles by id and state hold an item's text as its md5; the text itself is fetched from the batches
for the events that leave the state, so the batches list an item for as long as it is open. An epoch's shuffle
files go with the epoch, and event files are gzipped.

The file source's checkpoint takes each file once across restarts, the state store commits with
the epoch, and the file sink lists an epoch's files once, so a rerun adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.replies import task_results_of
from ..session import SHUFFLE_CLEANUP, settings

REPLY_SCHEMA = "batch_id string, response string"
RESULT_SCHEMA = "id string, input string, output string, reason string, model_name string, event string, tries int"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE, OPEN, RETRY = "done", "open", "retry"


class Intake(StatefulProcessor):
    """One id: ``done`` with its first parsed result, ``open`` for each epoch that brings none, ``retry`` when it is due."""

    def __init__(self, retry_seconds: float, max_tries: int, forget_seconds: float | None):
        self.retry_ms, self.max_tries = int(retry_seconds * 1000), max_tries
        self.forget_ms = None if forget_seconds is None else int(forget_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "tries int, input string, model_name string")
        # finished ids are only remembered, for as long as late replies are expected
        self.finished = handle.getValueState("finished", "tries int", self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        best = min(rows, key=lambda r: (r.output is None, r.output or "", r.reason or ""))  # reads the rows, whatever follows
        known = self.item.get()
        if not known and self.finished.exists():  # a finished id has no item
            return
        tries = known[0] + 1 if known else 1
        if known:  # timers are an open item's
            self._clear_timers()
        if best.output is not None:
            if known:
                self.item.clear()
            self.finished.update((tries,))
        else:
            self.item.update((tries, best.input, best.model_name))
            if tries < self.max_tries:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        yield Row(id=key[0], input=best.input, output=best.output, reason=best.reason, model_name=best.model_name,
                  event=OPEN if best.output is None else DONE, tries=tries)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        known = self.item.get()
        if known:
            tries, text, model = known
            yield Row(id=key[0], input=text, output=None, reason=None, model_name=model, event=RETRY, tries=tries)

    def _clear_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def close(self) -> None:
        pass


def parsed_stream(replies: DataFrame, batches: DataFrame) -> DataFrame:
    """The result rows of a stream of replies whose batches are a table."""
    one = replies.select("batch_id", "response").where("response IS NOT NULL").join(batches, "batch_id")
    return task_results_of(one.withColumn("has_reply", F.lit(True))).where("id IS NOT NULL")


def intake(replies: DataFrame, batches: DataFrame, retry_seconds: float = 1800, max_tries: int = 3,
           forget_seconds: float | None = None) -> DataFrame:
    """The events of a stream of replies (see ``Intake``), with state keyed by id."""
    held = batches.withColumn("item_texts", F.transform("item_texts", F.md5))
    events = parsed_stream(replies, held).groupBy("id").transformWithState(
        Intake(retry_seconds, max_tries, forget_seconds), RESULT_SCHEMA, "append", "processingTime")
    return with_texts(events, batches)


def with_texts(events: DataFrame, batches: DataFrame) -> DataFrame:
    """Events whose ``input`` is a text's md5, with the text that the batches have for the id."""
    members = F.explode(F.arrays_zip(F.col("original_ids").alias("id"), F.col("item_texts").alias("text"))).alias("m")
    texts = batches.select(members).select(F.col("m.id").cast("string").alias("id"), F.md5("m.text").alias("_md5"), "m.text")
    texts = texts.where("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id", "_md5"])
    # checkpoints of earlier versions hold open items' texts
    held = F.when(~F.col("input").rlike("^[0-9a-f]{32}$"), F.col("input"))
    out = events.withColumn("_md5", F.col("input")).join(texts, ["id", "_md5"], "left").withColumn("input", F.coalesce("text", held))
    return out.select(*events.columns)


def start_incremental_parse(spark: SparkSession, replies_dir: str, batches: DataFrame, results_path: str,
                            checkpoint_path: str, available_now: bool = True, retry_seconds: float = 1800, max_tries: int = 3,
                            forget_seconds: float | None = None, every: str = "30 seconds", max_files: int | None = None):
    """Start the stream; returns the StreamingQuery (call ``awaitTermination()``). ``max_files``: files an epoch takes at most."""
    reader = spark.readStream.schema(REPLY_SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(replies_dir)
    events = intake(stream, batches, retry_seconds, max_tries, forget_seconds)
    w = (events.writeStream.format("json").outputMode("append").option("path", results_path).option("ignoreNullFields", "false")
         .option("compression", "gzip").option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    # the store that keyed timers need; a run that ends with its files has no batches without files
    wanted = {STATE_PROVIDER: ROCKSDB, SHUFFLE_CLEANUP: "true"} | ({NO_DATA_BATCHES: "false"} if available_now else {})
    if available_now and not max_files:  # one epoch: its stores' local copies are of no use to a later one
        wanted[UNLOAD] = "true"
    with settings(spark, wanted):
        return w.start()  # a query keeps the settings that it is started with


def results(spark: SparkSession, results_path: str) -> DataFrame:
    """All events so far."""
    return spark.read.schema(RESULT_SCHEMA).json(results_path)


def latest_results(spark: SparkSession, results_path: str) -> DataFrame:
    """The current result per id: its output, or the last attempt that brought none."""
    best = F.min_by(F.struct("output", "reason", "input", "model_name"), F.struct(F.col("output").isNull(), -F.col("tries")))
    return results(spark, results_path).where(F.col("event") != RETRY).groupBy("id").agg(best.alias("r")).select("id", "r.*")


def due_items(spark: SparkSession, results_path: str) -> DataFrame:
    """Open items that are due for another prompt: offered since their last reply, and not done."""
    last = F.max(F.struct("tries", (F.col("event") == RETRY).alias("due"), "input", "model_name")).alias("last")
    state = results(spark, results_path).groupBy("id").agg(F.bool_or(F.col("event") == DONE).alias("done"), last)
    return state.where("NOT done AND last.due").select("id", "last.input", "last.model_name", "last.tries")
