"""Conversations over streams, with state by key in a RocksDB store: the last messages, what they named, and clearing.

Each processor keeps its state in parts of its own: a list of messages, from which only new ones are appended
until it is too long, and a value for what was named. Keys that were silent for the time to live leave no state;
a key that is cleared leaves none either. Rows of a batch are taken in the order of their turns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .state import FIELDS, HISTORY

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
NAMED = T.StructType([T.StructField("circuit", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("session", T.StringType()), T.StructField("lap", T.StringType()), T.StructField("drivers", T.StringType())])
HISTORY_OUT = "sid string, turn long, role string, content string"
NAMED_OUT = "sid string, turn long, circuit string, year int, session string, lap string, drivers string"


def durable_state(spark: SparkSession) -> None:
    """Keep the state of the session's streams in RocksDB, which holds more than memory does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ttl(days: float | None) -> int | None:
    return None if days is None else int(days * 86_400_000)


class History(StatefulProcessor):
    """The last messages of a key, as a list state; rows carry turn, role, content and clear."""

    def __init__(self, most: int = HISTORY, ttl_days: float | None = None):
        self.most, self.ttl_days = most, ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("messages", MESSAGE, _ttl(self.ttl_days))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = sorted((tuple(r[c] for c in ("turn", "role", "content", "clear")) for r in rows), key=lambda r: r[0])
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        cleared, added = False, []
        for turn, role, content, clear in fresh:
            if clear:
                cleared, added = True, []
            else:
                added.append((turn, role, content))
        now = ([] if cleared else held) + added
        if not now:
            self.held.clear()
        elif cleared or len(now) > self.most:
            now = now[-self.most :]
            self.held.put(now)
        else:
            self.held.appendList(added)
        for row in now or [(None, None, None)]:
            yield Row(sid=key[0], turn=row[0], role=row[1], content=row[2])


class Named(StatefulProcessor):
    """What a key's messages name, with what they leave out from earlier ones; rows carry turn, FIELDS (drivers joined
    by commas), telemetry and clear. Only telemetry turns leave something to later ones."""

    def __init__(self, ttl_days: float | None = None):
        self.ttl_days = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("named", NAMED, _ttl(self.ttl_days))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else (None,) * len(FIELDS)
        for row in sorted((r.asDict() for r in rows), key=lambda r: r["turn"]):
            if row["clear"]:
                held = (None,) * len(FIELDS)
            now = tuple(old if row[c] in (None, "") else row[c] for c, old in zip(FIELDS, held, strict=True))
            held = now if row["telemetry"] else held
            yield Row(sid=key[0], turn=row["turn"], **dict(zip(FIELDS, now, strict=True)))
        if any(x is not None for x in held):
            self.held.update(held)
        else:
            self.held.clear()


def history_stream(messages: DataFrame, most: int = HISTORY, ttl_days: float | None = None) -> DataFrame:
    """The whole history of every key that a batch touches; a cleared key gives one row without a turn."""
    rows = messages.select("sid", F.col("turn").cast("long"), "role", "content", F.coalesce("clear", F.lit(False)).alias("clear"))
    mode = "ProcessingTime" if ttl_days is not None else "None"
    return rows.groupBy("sid").transformWithState(History(most, ttl_days), HISTORY_OUT, "Update", mode)


def named_stream(turns: DataFrame, ttl_days: float | None = None) -> DataFrame:
    """The streaming form of state.carry_intent(), with drivers joined by commas."""
    drivers = F.array_join("drivers", ",") if dict(turns.dtypes)["drivers"].startswith("array") else F.col("drivers")
    rows = turns.select("sid", F.col("turn").cast("long"), "circuit", F.col("year").cast("int"), "session", "lap", drivers.alias("drivers"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("telemetry", "clear")))
    mode = "ProcessingTime" if ttl_days is not None else "None"
    return rows.groupBy("sid").transformWithState(Named(ttl_days), NAMED_OUT, "Append", mode)


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process all that has arrived in the stream's source into Parquet under target, a folder for each batch, and stop.

    A run that was stopped goes on from the checkpoint. A batch that is run again replaces its own folder, so
    its rows are there once.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    started = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def newest(histories: DataFrame) -> DataFrame:
    """The current messages of each key, from what run_to_end() wrote of history_stream(): those of its last batch."""
    last = histories.groupBy("sid").agg(F.max("batch").alias("batch"))
    return histories.join(last, ["sid", "batch"], "left_semi").where("turn IS NOT NULL").drop("batch")
