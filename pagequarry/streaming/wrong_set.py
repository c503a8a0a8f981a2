"""The wrong set as a stream: the same fold as in batch, as an aggregate or as a state of each question with a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pagequarry.operators.catalogue import kept_wrong
from pagequarry.session import discard, settle
from pagequarry.sources.store import filesystem, read_parts, replace_parts


def wrong_state(events: DataFrame, question: str = "question_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(question, is_wrong) by each question's last graded event; events may come late and in any order, as the state keeps the latest by ``order``. Write it in update or complete mode."""
    decided = events.where(F.col("is_correct").isNotNull())
    return decided.groupBy(question).agg(F.max_by("is_correct", F.struct(*order)).alias("ok")).select(question, (~F.col("ok")).alias("is_wrong"))


#: A question's last event.
LAST = "ts long, seq long, ok boolean, gone boolean"
CHANGES = "question_id string, is_wrong boolean"
MARKS = "question_id string"
#: Before any event: what a null time or number counts as, and the marks that are there at the start.
FIRST = -(2**63)
#: Parts that the marks are stored in; a batch rewrites those that its changes fall into.
BUCKETS = 256
DAY = 24 * 60 * 60 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State that can end by itself needs the store on disk. Without rows there is no batch: one would follow another for good, as timers may end at any time.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class WrongMarks(StatefulProcessor):
    """A question's last event as its state; a row goes out where the mark changes.

    An event counts if it is later by (ts, seq) than the one kept, whenever it arrives, so the
    marks are those of the batch fold; of two at one place the correct one counts. A question
    that is gone has no mark, and no event brings it back: With the first batch after
    ``grace_ms``, when none is under way any more, its state goes too. So there is one small row for each question that
    exists or went lately.
    """

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((FIRST, FIRST, False, False))

    def handleInputRows(self, key, rows, timerValues):
        kept = self.last.get() if self.last.exists() else None
        kept = None if kept is None else tuple(kept)
        events = [(r.ts, r.seq, bool(r.ok), r.gone) for r in rows]
        if kept is not None and kept[3]:
            return
        gone = any(e[3] for e in events)
        if gone:
            now = (FIRST, FIRST, True, True)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
        else:
            now = max([*events, *([kept] if kept else [])], key=lambda e: e[:3])
        if now != kept:
            self.last.update(now)
        before, after = kept is not None and not kept[2], not now[2]
        # that a question is gone is always said, as its mark may have been stored by other ways
        if before != after or gone:
            yield Row(question_id=key[0], is_wrong=after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and self.last.get()[3]:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def mark_changes(events: DataFrame, stored: DataFrame, grace_ms: int = 7 * DAY) -> DataFrame:
    """(question_id, is_wrong) whenever a question's mark changes, as a stream in update mode.

    ``events`` is a stream of (question_id, ts, seq, is_correct) and, if it has it, ``removed``:
    true where the question is gone. ``stored`` (question_id) are the marks at the start, which
    any event is later than. Ids are equal in any case; a null id is no question. Events without
    a grade that remove nothing are passed over before they are dealt to the questions.
    """
    place = lambda c: F.coalesce(as_number(F.col(c), events.schema[c].dataType), F.lit(FIRST))
    gone = F.coalesce("removed", F.lit(False)) if "removed" in events.columns else F.lit(False)
    asked = events.select(
        F.lower("question_id").alias("question_id"), place("ts").alias("ts"), place("seq").alias("seq"), F.col("is_correct").alias("ok"),
        gone.alias("gone")
    ).where("question_id IS NOT NULL AND (ok IS NOT NULL OR gone)")
    first = stored.select(F.lower("question_id").alias("question_id")).where("question_id IS NOT NULL").distinct()
    return asked.groupBy("question_id").transformWithState(WrongMarks(grace_ms), CHANGES, "Update", "ProcessingTime", first.groupBy("question_id"))


def as_number(value: Column, kind: T.DataType) -> Column:
    """A time's microseconds, those of one without a zone as it stands, or a number as it is."""
    if isinstance(kind, T.TimestampNTZType):
        since = value - F.lit("1970-01-01").cast("timestamp_ntz")
        return (since.cast("decimal(24,6)") * 1000000).cast("long")
    return F.unix_micros(value) if isinstance(kind, T.TimestampType) else value.cast("long")


def bucket(buckets: int = BUCKETS):
    return F.pmod(F.crc32(F.col("question_id").cast("binary")), F.lit(buckets)).cast("string")


def merge_marks(changes: DataFrame, folder: str, questions: DataFrame | None = None) -> None:
    """Apply one batch of changes to the marks in ``folder``; only buckets with a changed id are rewritten.

    A batch that is applied again leaves what it left before. Marks of ids that ``questions``
    (id), if given, don't have are not stored.
    """
    changed = settle(changes.withColumn("bucket", bucket()), "mark-changes")
    try:
        touched = changed.select("bucket").distinct()
        if changed.isEmpty():
            return
        kept = read_parts(changes.sparkSession, folder, f"{MARKS}, bucket string", "bucket").join(
            F.broadcast(touched), "bucket", "left_semi"
        ).join(changed, "question_id", "left_anti")
        marks = kept.select("question_id", "bucket").unionByName(changed.where("is_wrong").select("question_id", "bucket"))
        replace_parts(marks if questions is None else kept_wrong(marks, questions), folder, "bucket", touched)
    finally:
        discard(changed)


def stored_marks(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id) of the wrong set that the stream keeps in ``folder``."""
    return read_parts(spark, folder, f"{MARKS}, bucket string", "bucket").select("question_id")


def store_marks(marks: DataFrame, folder: str) -> None:
    """A wrong set (question_id) that a stream is to go on from."""
    ids = marks.select(F.lower("question_id").alias("question_id")).where("question_id IS NOT NULL").distinct()
    replace_parts(ids.withColumn("bucket", bucket()), folder, "bucket")


def follow(
    events: DataFrame, folder: str, checkpoint: str, questions: DataFrame | None = None, grace_ms: int = 7 * DAY, **trigger
) -> StreamingQuery:
    """Start the stream that keeps the wrong set in ``folder`` up to date; started again with ``checkpoint`` it goes on where it ended.

    The marks that are in the folder at the first start are written beside the checkpoint, as
    the state begins with them and the folder's own parts are replaced. ``trigger`` is that of
    writeStream.
    """
    spark = events.sparkSession
    beginning = f"{checkpoint.rstrip('/')}-initial"
    fs, done = filesystem(spark, f"{beginning}/_SUCCESS")
    if not fs.exists(done):
        stored_marks(spark, folder).write.mode("overwrite").parquet(beginning)
    changes = mark_changes(events, spark.read.schema(MARKS).parquet(beginning), grace_ms)
    stream = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "1 minute"})
    ).foreachBatch(lambda df, _: merge_marks(df, folder, questions))
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():  # the stream takes the session's settings as they are when it starts
            spark.conf.set(key, value)
        return stream.start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
