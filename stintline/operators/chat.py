"""One question to an answer: classify, parse, merge with the last question, fetch, check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..streaming import state
from . import lap_query

CLARIFY = "which circuit?"
_MERGED = ("circuit", "year", "session", "lap_number")


@dataclass
class Reply:
    mode: str
    source: str
    intent: dict
    answer: lap_query.Answer | None = None
    text: str = ""


def parse(spark: SparkSession, message: str) -> dict:
    """Mode, pushback and intent of one message."""
    t = F.col("t")
    row = spark.createDataFrame([(message,)], "t string").select(X.mode(t).alias("mode"), X.pushback(t).alias("pushback"), X.intent(t).alias("intent"), X.topics(t).alias("topics")).first()
    return {"mode": row["mode"], "pushback": row["pushback"], "topics": row["topics"], **row["intent"].asDict()}


def merged(intent: dict, last: dict | None) -> dict:
    """The intent, with what it leaves out taken from the last one; a wish for averages isn't."""
    if not last:
        return intent
    out = dict(intent)
    lap_named = out["lap_number"] is not None or out.get("lap_fastest")
    for k in _MERGED:
        if out.get(k) is None and not (k == "lap_number" and lap_named):
            out[k] = last.get(k)
    out["drivers"] = out["drivers"] or list(last.get("drivers") or [])
    return out


def reply(spark: SparkSession, message: str, laps: DataFrame, sessions: DataFrame, last: dict | None = None, ingest=None) -> Reply:
    """What is known of a message: general talk needs the model, a lap question is fetched and checked.

    A pushback is always a lap question. The intent of the reply is what the next message merges with.
    """
    said = parse(spark, message)
    if said["mode"] == "general" and not said["pushback"]:
        return Reply("general", "model_knowledge", said)
    intent = merged(said, last)
    if not intent["circuit"]:
        return Reply("telemetry" if said["pushback"] else "general", "model_knowledge", intent, text=CLARIFY if said["pushback"] else "")
    stored = spark.range(1).select(X.stored_circuit(F.lit(intent["circuit"])).alias("c")).first()["c"]
    found = lap_query.answer(intent | {"circuit": stored}, laps, sessions, ingest)
    return Reply("telemetry", found.source, intent, found)


HISTORY = "sid string, role string, content string, mode string, id string, timestamp double, clear boolean"


class Conversations:
    """The messages of all conversations, in a folder of Parquet files that only grows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], HISTORY).write.mode("append").parquet(folder)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(HISTORY).parquet(self.folder)

    def add(self, sid: str, *messages: tuple[str, str], mode: str = "general") -> None:
        """Append (role, content) messages in their order."""
        rows = [(sid, role, content, mode, False, i) for i, (role, content) in enumerate(messages)]
        self._append(rows)

    def clear(self, sid: str) -> None:
        """Forget a conversation: a row says that what came before is gone."""
        self._append([(sid, None, None, None, True, 0)])

    def _append(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, "sid string, role string, content string, mode string, clear boolean, _n int")
        stamped = state.stamped(df).withColumn("timestamp", F.col("timestamp") + F.col("_n") / 1e6)
        stamped.select("sid", "role", "content", "mode", "id", "timestamp", "clear").coalesce(1).write.mode("append").parquet(self.folder)

    def history(self, sid: str, most: int = state.HISTORY) -> list[tuple[str, str]]:
        """The last messages of a conversation as (role, content), oldest first; at most `most` rows come back."""
        mine = state.kept_messages(self._rows().where(F.col("sid") == sid), "sid", ["timestamp", "id"], F.col("clear"), most)
        return [(r["role"], r["content"]) for r in mine.orderBy("timestamp", "id").collect()]

    def health(self) -> dict:
        """Whether the folder can be read, and how many conversations it holds."""
        return {"status": "ok", "conversations": self._rows().where("NOT clear").select("sid").distinct().count()}
