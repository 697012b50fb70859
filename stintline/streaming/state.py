"""Per-key state of a conversation, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

HISTORY = 50


def last_messages(messages: DataFrame, key: str, order: list[str], most: int = HISTORY) -> DataFrame:
    """The last so many rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def since_clear(rows: DataFrame, key: str, order: list[str], clear: Column) -> DataFrame:
    """rows with _since: how often their key was cleared up to them. Rows of one number share their state."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_since", F.sum(F.coalesce(clear, F.lit(False)).cast("int")).over(w))


def kept_messages(messages: DataFrame, key: str, order: list[str], clear: Column, most: int = HISTORY) -> DataFrame:
    """The last so many rows of each key since it was last cleared; the clearing rows themselves are none."""
    told = since_clear(messages.withColumn("_clear", F.coalesce(clear, F.lit(False))), key, order, F.col("_clear"))
    newest = told.withColumn("_last", F.max("_since").over(Window.partitionBy(key))).where("_since = _last AND NOT _clear")
    return last_messages(newest.drop("_since", "_last", "_clear"), key, order, most)


_HELD = T.StructType([T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("contents", T.ArrayType(T.StringType()))])


def last_messages_stream(messages: DataFrame, most: int = HISTORY) -> DataFrame:
    """The streaming form of last_messages() over rows sid, turn, role, content and clear.

    Each batch gives the whole history, of at most so many rows, of every key that it touches; a key
    that is cleared leaves no state and gives one row without a turn.
    """
    schema = "sid string, turn long, role string, content string"

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            for row in frame.sort_values("turn").itertuples(index=False):
                held = [] if row.clear else [*held, (row.turn, row.role, row.content)][-most:]
        if held:
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
        elif state.exists:
            state.remove()
        rows = [(key[0], *h) for h in held] or [(key[0], None, None, None)]
        yield pd.DataFrame(rows, columns=["sid", "turn", "role", "content"]).astype({"turn": "Int64"})

    return messages.groupBy("sid").applyInPandasWithState(merge, schema, _HELD, "update", "NoTimeout")


#: Fields of an intent that a follow-up question may leave out. lap is a number or 'fastest', as text.
FIELDS = ["circuit", "year", "session", "lap", "drivers"]


def _known(field: str) -> Column:
    """A field's value, null if it is missing: no driver named is as good as none."""
    return F.when(F.size(field) > 0, F.col(field)) if field == "drivers" else F.col(field)


def carry_intent(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Turns with the FIELDS that they leave out filled from earlier turns of the key.

    Where turns have a column telemetry, only turns with it leave something to later ones; where they
    have a column clear, a turn with it forgets all that was before.
    """
    fields = [c for c in turns.columns if c in FIELDS]
    leaves = F.col("telemetry") if "telemetry" in turns.columns else F.lit(True)
    told = since_clear(turns, key, order, F.col("clear") if "clear" in turns.columns else F.lit(False))
    before = Window.partitionBy(key, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = {c: F.coalesce(_known(c), F.last(F.when(leaves, _known(c)), ignorenulls=True).over(before)) for c in fields}
    return told.select(*(filled[c].alias(c) if c in fields else F.col(c) for c in turns.columns))


def stamped(messages: DataFrame) -> DataFrame:
    """messages (role, content) with an id of their own and the seconds since 1970."""
    return messages.withColumns({"id": F.uuid(), "timestamp": F.unix_micros(F.current_timestamp()) / 1e6})


def model_messages(history: DataFrame, doubted: Column) -> DataFrame:
    """History for the next reply; where the user doubts it, earlier numeric claims are struck out."""
    strike = doubted & (F.col("role") == "assistant")
    return history.withColumn("content", F.when(strike, X.redacted(F.col("content"))).otherwise(F.col("content")))


def ingest_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: list[str]):
    """Load the files that arrive in a folder, each key once; returns the started query.

    Files are tracked by the checkpoint; a batch that is run again after a failure appends nothing
    twice, because keys already in the target are left out.
    """

    def load(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(key)
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(session.read.schema(schema).parquet(target).select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_NAMES = T.ArrayType(T.StringType())
_STATE = T.StructType([T.StructField(n, t) for n, t in (("circuit", T.StringType()), ("year", T.IntegerType()), ("session", T.StringType()), ("lap", T.StringType()), ("drivers", _NAMES))])


def carry_intent_stream(turns: DataFrame) -> DataFrame:
    """The streaming form of carry_intent() over rows sid, turn, FIELDS, telemetry and clear.

    What a key's telemetry turns named is its state, which clear removes; rows of a batch are taken by turn.
    """
    schema = T.StructType([T.StructField("sid", T.StringType()), T.StructField("turn", T.LongType()), *_STATE.fields])

    def known(x):
        return None if x is None or isinstance(x, float) and x != x or hasattr(x, "__len__") and len(x) == 0 else x

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None] * len(FIELDS)
        for frame in frames:
            out = []
            for row in frame.sort_values("turn").itertuples(index=False):
                if row.clear:
                    held = [None] * len(FIELDS)
                now = [old if known(x) is None else x for x, old in zip((getattr(row, c) for c in FIELDS), held, strict=True)]
                if row.telemetry:
                    held = now
                out.append((key[0], row.turn, now[0], None if now[1] is None else int(now[1]), now[2], now[3], None if now[4] is None else list(now[4])))
            if any(x is not None for x in held):
                state.update((held[0], None if held[1] is None else int(held[1]), held[2], held[3], None if held[4] is None else list(held[4])))
            elif state.exists:
                state.remove()
            yield pd.DataFrame(out, columns=["sid", "turn", *FIELDS]).astype({"year": "Int32"})

    return turns.groupBy("sid").applyInPandasWithState(merge, schema, _STATE, "append", "NoTimeout")
