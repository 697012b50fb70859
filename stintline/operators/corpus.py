"""Building a chat corpus: examples, deduplication, tags, splits, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.constants import TEST_CIRCUITS, VALIDATION_CIRCUITS


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def example(question: Column, answer: Column, system: str | None = None) -> Column:
    turns = [message("user", question), message("assistant", answer)]
    return F.array(*([message("system", F.lit(system))] if system else []), *turns)


def first_of(messages: Column, role: str, place: int = 1) -> Column:
    """Content of the first (or, at place -1, the last) message of a role, or null."""
    mine = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(mine, F.lit(place))["content"]


def with_system(messages: Column, prompt: str) -> Column:
    """The messages under the canonical system prompt, replacing one that leads them."""
    rest = F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, 2, 1 << 30)).otherwise(messages)
    return F.concat(F.array(message("system", F.lit(prompt))), rest)


def spoken_text(messages: Column, joint: str = " ") -> Column:
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.array_join(F.transform(said, lambda m: m["content"]), joint)


def conversation_examples(turns: DataFrame, prompt: str) -> DataFrame:
    """Of each conversation (conv_id, turn, role, text): the messages under the canonical prompt, counted, the
    prompt, its first question, its last answer, and the characters spoken.

    All of these are aggregates that tasks begin where the turns lie, so a conversation of any length is
    never gathered.
    """
    said = F.when(F.col("role").isin("user", "assistant"), F.col("text"))
    of = lambda role: F.when(F.col("role") == role, F.col("turn"))
    held = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.min_by("role", "turn").alias("first"),
        F.min_by("text", of("user")).alias("question"),
        F.max_by("text", of("assistant")).alias("answer"),
        F.sum(F.length(said)).alias("letters"),
        F.count(said).alias("spoken"),
    )
    led = F.coalesce(F.col("first") == "system", F.lit(False)).cast("int")
    chars = F.coalesce(F.col("letters"), F.lit(0)) + F.greatest(F.col("spoken") - 1, F.lit(0))
    return held.select("conv_id", (F.col("turns") + 1 - led).alias("n"), F.lit(prompt).alias("system"), "question", "answer", F.when(F.col("spoken") > 0, chars).alias("chars"))


def first_wins(examples: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first by the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return examples.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def split_of(circuit: Column) -> Column:
    return F.when(circuit.isin(*TEST_CIRCUITS), "test").when(circuit.isin(*VALIDATION_CIRCUITS), "val").otherwise("train")


def tagged(examples: DataFrame, text: str) -> DataFrame:
    """examples with circuit (null if none is named) and split."""
    out = examples.withColumn("_low", F.lower(F.col(text))).withColumn("circuit", X.corpus_circuit_of(F.col("_low"))).drop("_low")
    return out.withColumn("split", split_of(F.col("circuit")))


def leakage(examples: DataFrame, key: str) -> DataFrame:
    """Keys that more than one split holds; empty for a sound corpus."""
    return examples.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def require_no_leakage(examples: DataFrame, key: str) -> None:
    if not leakage(examples, key).isEmpty():
        raise ValueError("splits share examples")


def sample_per_category(examples: DataFrame, category: str, key: str, most: int, total: int, seed: int) -> DataFrame:
    """A seeded sample: at most so many of each category, then so many in all; the same on any cluster."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    w = Window.partitionBy(category).orderBy("_draw", key)
    ranked = examples.withColumn("_draw", draw).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return ranked.orderBy("_draw", key).limit(total).drop("_draw", "_rn")


def clean(examples: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason): examples whose tyre claims are impossible are rejected."""
    judged = examples.withColumn("reason", X.bad_degradation(F.col(text)))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def generate(candidates: DataFrame, generator, category: str, done: DataFrame, quota: int, facts: str = "facts") -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): responses of generator, a function from a DataFrame to the same with response.

    Only as many candidates as each category still lacks are tried (resuming where done, the rows
    kept before, left off); responses that state numbers the facts don't ground are discarded.
    """
    have = done.groupBy(category).agg(F.count(F.lit(1)).alias("_have"))
    w = Window.partitionBy(category).orderBy(F.md5(F.col(facts)), facts)
    lacking = candidates.join(have, category, "left").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") + F.coalesce("_have", F.lit(0)) <= quota)
    told = generator(lacking.drop("_have", "_rn"))
    bad = X.fails_guard(F.col(facts), F.col("response"))
    return told.where(~bad), told.where(bad)


def assemble(sources: dict[str, DataFrame]) -> DataFrame:
    """question, answer, source, circuit and split of the corpus that sources (question, answer) make.

    Sources come in their order: of equal questions the first one's stays, within a source the least
    answer. The circuit is the one that question and answer name, and decides the split.
    """
    parts = [df.select(F.lit(i).alias("_place"), F.lit(name).alias("source"), "question", "answer") for i, (name, df) in enumerate(sources.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # by a fixed number: all cores share in what follows, where AQE would merge the pieces into a few long tasks
    dealt = every.repartition(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question")
    kept = first_wins(dealt, "question", ["_place", "answer"])
    told = tagged(kept.withColumn("_text", F.concat_ws(" ", "question", "answer")), "_text")
    return told.select("question", "answer", "source", "circuit", "split")


def write_splits(corpus: DataFrame, folder: str, system: str) -> None:
    """Write the corpus as JSON lines of chat examples, a folder for each split, unless splits share a question."""
    require_no_leakage(corpus, "question")
    shown = corpus.select("split", example(F.col("question"), F.col("answer"), system).alias("messages"))
    shown.write.mode("overwrite").partitionBy("split").json(folder)
