"""Inbound messages to intents and readings, with a session per phone.

Four steps, each usable alone:

1. ``classify`` (batch, per micro-batch) gives every message its kind by one expression,
   with the well that its place text stands for, resolved by the place index.
2. ``write_packets`` writes a stream's messages as packets: the messages of a phone in
   order, at most ``PACKET`` to a row, so that a long backlog of one phone becomes many
   bounded rows, written round after round.
3. ``converse`` keeps a session per phone in a state store and moves it along the table
   ``NEXT``; packets that come before their turn wait in a list state, and a timer
   removes sessions that have been idle for long.
4. ``submit_reports`` passes readings on to the report stream.

A number is a reading only when the session is not waiting for a menu choice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wellspring.config import DEFAULTS, Settings
from wellspring.functions.text import parse_depth
from wellspring.operators.places import resolve_places
from wellspring.operators.reports import longest_record_well
from wellspring.streaming.reports import write_reports

# Command words and workshop choices.
HELP_WORDS = ("HELP", "MENU", "?")
WORKSHOP_CHOICES = ("1", "2", "3")
LEAST_PLACE = 3

PACKET = 5000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "message_id long, sent_us long, kind string, depth double, place_well string, user_well string, workshop string"
_MESSAGES = "array<struct<" + MESSAGE.replace(", ", ",").replace(" ", ":") + ">>"
PACKETS = f"phone string, batch long, round int, messages {_MESSAGES}"
INTENTS = "message_id long, phone string, sent_at timestamp, action string, well_id string, level_mbgl double, workshop string"
_GIVEN = INTENTS.replace("sent_at timestamp", "sent_us long")

STEPS = ("idle", "choosing", "placing", "measuring")
NUMBERS, TEXTS = ("choice", "number"), ("place", "hint", "other")
#: What follows: (steps, kinds, whether a well is known) -> (next step, action); ``=`` keeps
#: the step, None stands for both, and of two lines that fit the first holds. ``hint`` is
#: a place text too short to open a conversation with.
LINES = [
    (STEPS, ("help",), None, "=", "help"),
    (STEPS, ("stop",), None, "=", "stop"),
    (STEPS, ("book",), None, "choosing", "book"),
    (STEPS, ("my_score",), None, "=", "score"),
    (STEPS, ("score",), True, "=", "score"),
    (STEPS, ("score",), False, "=", "ask_place"),
    (("choosing",), ("choice",), None, "idle", "booked"),
    (("placing",), ("place", "hint"), None, "measuring", "ask_depth"),
    (("placing",), ("other",), None, "placing", "retry_place"),
    (STEPS, NUMBERS, True, "idle", "report"),
    (STEPS, (*NUMBERS, "hint", "other"), False, "placing", "ask_place"),
    (STEPS, ("place",), False, "measuring", "ask_depth"),
    (("choosing",), TEXTS, True, "idle", "help"),
    (STEPS, TEXTS, True, "=", "help"),
]
NEXT = {
    (step, kind, known): (step if then == "=" else then, action)
    for steps, kinds, when, then, action in reversed(LINES)
    for step in steps
    for kind in kinds
    for known in ((True, False) if when is None else (when,))
}


def classify(messages: DataFrame, users: DataFrame, wells: DataFrame, gaz: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(message_id, phone, body, sent_at) with its kind and what the tables know of it, a row per message.

    ``users`` holds phone, well_id (their well) and entity_id. A place text that stands
    for an area means the area's well with the longest record; a city means none.
    """
    body = F.trim(F.coalesce("body", F.lit("")))
    command = F.upper(body)
    known = users.select("phone", F.col("well_id").alias("user_well"), F.col("entity_id").alias("user_entity"))
    asked = messages.withColumns({"depth": parse_depth(body), "role": F.lit("farmer"), "place": body}).join(known, "phone", "left")
    found = resolve_places(asked, gaz, index=index)
    best = longest_record_well(wells).select(F.col("taluka").alias("entity_id"), F.col("well_id").alias("best"))
    met = found.join(best, "entity_id", "left")
    at = F.when(F.col("entity_type") == "well", F.col("entity_id")).when(F.col("entity_type") == "taluka", F.col("best"))
    kind = (
        F.when(command.isin(*HELP_WORDS), "help")
        .when(command == "STOP", "stop")
        .when(command == "BOOK", "book")
        .when((command == "SCORE") & F.col("user_entity").isNotNull(), "my_score")
        .when(command == "SCORE", "score")
        .when(command.isin(*WORKSHOP_CHOICES), "choice")
        .when(F.col("depth").isNotNull(), "number")
        .when(at.isNull(), "other")
        .when(F.length(body) >= LEAST_PLACE, "place")
        .otherwise("hint")
    )
    return met.select(
        "message_id", "phone", "sent_at", kind.alias("kind"), "depth", at.alias("place_well"), "user_well", "user_entity",
        F.when(command.isin(*WORKSHOP_CHOICES), command).alias("workshop"),
    )


def packed(classified: DataFrame, batch: int, size: int = PACKET) -> DataFrame:
    """The messages of each phone in order, ``size`` to a row.

    Counting along a phone takes no memory (the sort may spill); only a packet is ever
    collected.
    """
    order = Window.partitionBy("phone").orderBy("sent_at", "message_id")
    turn = F.floor((F.row_number().over(order) - 1) / size).cast("int")
    message = F.struct(*(f.split()[0] for f in MESSAGE.split(", ")))
    ordered = F.sort_array(F.collect_list(F.struct("sent_us", "message_id", message.alias("m")))).alias("messages")
    rows = classified.withColumns({"round": turn, "sent_us": F.unix_micros("sent_at")}).groupBy("phone", "round").agg(ordered)
    return rows.select("phone", F.lit(batch).cast("long").alias("batch"), "round", F.col("messages.m").alias("messages"))


def write_packets(
    stream: DataFrame, users: DataFrame, wells: DataFrame, gaz: DataFrame, path: str, checkpoint: str,
    index: DataFrame | None = None, size: int = PACKET, available_now: bool = True,
) -> StreamingQuery:
    """Classify each micro-batch and write its packets, round by round, below ``path``.

    A repeated batch overwrites its own folders. Rounds are written one after another, so
    a reader that takes files in the order of their times meets them in turn.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        rows = packed(classify(batch, users, wells, gaz, index), number, size).persist()
        last = rows.agg(F.max("round")).first()[0]
        for k in range(-1 if last is None else last + 1):
            rows.where(F.col("round") == k).write.mode("overwrite").parquet(f"{path}/batch_{number:012d}_{k:06d}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Conversation(StatefulProcessor):
    """A phone's session: where the conversation stands, and packets that came before their turn."""

    def __init__(self, idle_s: float | None, timers: bool):
        self.idle_s, self.timers = idle_s, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "step string, well_id string, last long, timer long")
        self.turn = handle.getValueState("turn", "batch long, round int")
        self.pending = handle.getListState("pending", f"batch long, round int, messages {_MESSAGES}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        waiting = [tuple(p) for p in self.pending.get()] + [(r["batch"], r["round"], r["messages"]) for r in rows]
        waiting.sort(key=lambda p: p[:2])
        step, well, last, timer = self.session.get() if self.session.exists() else ("idle", None, None, None)
        turn = tuple(self.turn.get()) if self.turn.exists() else None
        early = []
        for batch, round_, messages in waiting:
            if turn and (batch, round_) < turn:
                continue  # written twice
            if early or round_ != (turn[1] if turn and turn[0] == batch else 0):
                early.append((batch, round_, messages))  # an earlier round is still on its way
                continue
            for m in messages:
                if last is not None and self.idle_s is not None and m["sent_us"] - last > self.idle_s * 1e6:
                    step, well = "idle", None
                last = m["sent_us"] if last is None else max(last, m["sent_us"])
                known = well or m["user_well"]
                step, action = NEXT[step, m["kind"], known is not None]
                well = {"report": known, "ask_depth": m["place_well"]}.get(action, well)
                yield Row(
                    message_id=m["message_id"], phone=key[0], sent_us=m["sent_us"], action=action,
                    well_id=well if action in ("report", "ask_depth", "score") else None,
                    level_mbgl=m["depth"] if action == "report" else None,
                    workshop=m["workshop"] if action == "booked" else None,
                )
            turn = (batch, round_ + 1)
        if early:
            self.pending.put(early)
        else:
            self.pending.clear()
        if turn:
            self.turn.update(turn)
        if self.timers:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.idle_s * 1000)
            self.handle.registerTimer(timer)
        self.session.update((step, well, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if not self.pending.exists():
            self.session.clear()
        return iter(())

    def close(self) -> None:
        pass


def converse(packets: DataFrame, idle_s: float | None = None, timers: bool = False) -> DataFrame:
    """Stream of packets to intents; append mode, with the RocksDB state store.

    A session ends when the next message comes more than ``idle_s`` seconds after the
    last; None keeps sessions for good. With ``timers`` a session that has been idle for
    as long by the clock is also removed from the state store. Such a query runs batches
    for its timers alone, so it has to be stopped; it does not end as an available-now one.
    """
    if timers and idle_s is None:
        raise ValueError("timers need idle_s")
    # The session travels whole: Spark also reads it in a process that may not find this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    found = packets.groupBy("phone").transformWithState(
        statefulProcessor=Conversation(idle_s, timers), outputStructType=_GIVEN, outputMode="Append",
        timeMode="ProcessingTime" if timers else "None",
    )
    return found.select(
        "message_id", "phone", F.timestamp_micros("sent_us").alias("sent_at"), "action", "well_id", "level_mbgl", "workshop"
    )


def read_packets(spark, path: str, files: int = 64) -> DataFrame:
    """Packets as a stream, oldest files first; a trigger takes at most ``files`` files."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def write_intents(intents: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = intents.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_scores(intents: DataFrame, users: DataFrame, scores: DataFrame) -> DataFrame:
    """Intents whose ``score`` names the entity asked for, or is ``no_score`` where it has none."""
    who = users.select("phone", F.col("entity_id").alias("user_entity"))
    out = intents.join(who, "phone", "left").withColumn(
        "entity_id", F.when(F.col("action") == "score", F.coalesce("user_entity", "well_id"))
    )
    known = scores.select("entity_id", "score", "band").dropDuplicates(["entity_id"])
    missing = (F.col("action") == "score") & F.col("score").isNull()
    return out.join(known, "entity_id", "left").withColumn("action", F.when(missing, "no_score").otherwise(F.col("action"))).drop("user_entity")


def reports_of(intents: DataFrame) -> DataFrame:
    """Readings among intents, as reports (batch or stream)."""
    day: Column = F.col("sent_at").cast("date")
    return intents.where(F.col("action") == "report").select(
        F.concat(F.lit("msg"), F.col("message_id")).alias("report_id"), F.col("sent_at").alias("created_at"), "well_id",
        "level_mbgl", day.alias("reported_for"), "phone",
    )


def submit_reports(
    intents: DataFrame, readings: DataFrame, wells: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Readings of an intent stream, validated and written with the other reports."""
    return write_reports(reports_of(intents), readings, wells, path, checkpoint, settings)
