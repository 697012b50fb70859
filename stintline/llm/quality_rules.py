"""Operator 3, quality rules: risk-controlled cutoffs from labelled holdouts.

Each rule has a statistic of a text, a whole number on a grid that covers all values, and rejects the texts above
a cutoff. Labelled texts that pass the base rules count once in each stratum, however many copies of them are
labelled, and are dealt into two halves by a hash of the text, so that copies lie on one side. On the first half, each rule proposes cutoffs for each stratum: among those that lose no more of the good texts than a
level allows, the most lenient whose balance, the share of bad texts caught less that of good ones lost, comes
up to the level's part of the best; a rule that catches nothing has none. The levels go from lenient to strict, and what a level rejects the
next one rejects too. On the second half, the hypothesis that the rules of a level together reject more
than RISK of the good texts of the stratum has the exact p-value P(Binomial(n, RISK) <= k), with k of n
good texts rejected. Two corrections keep the chance of any wrong certificate under DELTA: each stratum
tests at DELTA / number of strata (Bonferroni), and within a stratum levels are tested in order, stopping
at the first that isn't certified (fixed sequence). The last certified level gives the cutoffs.

So, with probability 1 - DELTA, in no stratum do these rules reject more than RISK of the different good
texts that pass the base rules; copies of a text share its verdict. Good texts that fail the base are not part of this guarantee: the base rejects
them whatever the labels say. A stratum with too few labels gets no cutoff and loses no text but by the base.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BROADCAST_BYTES, SLICE, durable, map_rows, small_enough

RISK, DELTA = 0.03, 0.05
#: For each level, how many good texts of a thousand in the first half a rule may lose, and the
#: percentage of the best balance that its cutoff must reach.
LEVELS = ((0, 50), (0, 90), (0, 100), (2, 100), (5, 100))
#: Binary digits that a statistic keeps: values below 2^13 are exact, greater ones lose their lowest digits, so that
#: candidates are few (at most 2^12 for each doubling) and no value is out of a cutoff's reach.
DIGITS = 13
#: Tasks that rows of a stratum are dealt to, where cutoffs are too large to broadcast.
PARTS = 32
#: Fixed values of the base statistics.
WHITE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

#: rule -> (numerator, denominator, scale, whether high values are bad)
RULES: dict[str, tuple[str, str, int, bool]] = {
    "symbols": ("n_symbols", "word_chars", 1000, True),
    "marks": ("n_marks", "n_words", 1000, True),
    "capitals": ("n_capitals", "word_chars", 1000, True),
    "line_copies": ("n_dup_lines", "n_lines", 1000, True),
    "repeats": ("n_repeat_words", "n_words", 1000, True),
    "short_words": ("word_chars", "n_words", 100, False),
    "long_words": ("word_chars", "n_words", 100, True),
    "doubles": ("n_doubles", "n_words", 1000, True),
}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_doubles", "n_lines"]
_WORD = re.compile(f"[^{WHITE}]+")
_CAPITAL = re.compile("[A-Z]")


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the list holds at least twice."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    covered, n = 0, 0  # words before `covered` are counted
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    for i, w in enumerate(windows):
        if w in twice:
            n += i + size - max(i, covered)
            covered = i + size
    return n


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for a text; null is no words and no lines."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()  # bytes split at the six white-space characters alone
    seen, copies, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                copies += 1
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        copies,
        repeated_words(words),
        text.count("!") + text.count("?"),
        len(_CAPITAL.findall(text)),
        sum(a == b for a, b in zip(words, words[1:])),
        lines,
    )


def with_counts(docs: DataFrame, carry: list[str], text_col: str = "text", name: str = "_counts") -> DataFrame:
    """The columns to carry, and a struct of COUNTS of the text under name."""
    columns = [*carry] if text_col in carry else [*carry, text_col]
    at, keep = columns.index(text_col), len(carry)
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(name, counts)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = [text_counts(t) for t in part.column(at).to_pylist()]
                fields = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
                added = pa.StructArray.from_arrays(fields, fields=[*arrow.field(keep).type])
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*columns, added], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics() -> Column:
    """The rules' statistics of a row of COUNTS, in order."""
    out = []
    for over, under, scale, high in RULES.values():
        ratio = f"{over} * {scale} div greatest(1, {under})"
        value = F.expr(f"{ratio} - ({ratio}) % shiftleft(1L, greatest(0, length(bin({ratio})) - {DIGITS}))")
        out.append(value if high else -value)
    return F.array(*out)


def log_tail(n: int, k: int, risk: float) -> float:
    """log P(Binomial(n, risk) <= k) for k <= n * risk: terms fall from k down, and those that can't be seen are left out."""
    from math import exp, lgamma, log, log1p

    def term(j):
        return lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(risk) + (n - j) * log1p(-risk)

    top, total = term(k), 0.0
    for j in range(k, -1, -1):
        share = exp(term(j) - top)
        total += share
        if share < 1e-18:
            break
    return top + log(total)


def certified(n: int, ks: list[int], tests: int, risk: float, delta: float) -> int:
    """How many levels, with ks of n good texts rejected, are certified in order."""
    from math import log

    for i, k in enumerate(ks):
        if not n or k > n * risk or log_tail(n, k, risk) > log(delta / tests):
            return i
    return len(ks)


def proposals(half: DataFrame, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """stratum and proposed: for each level the rules' cutoffs (null: none), from rows (stratum, good, v).

    Rows are counted by rule and value where they lie, so a window sees the grid's rows of a stratum and rule at most.
    """
    each = half.select("stratum", "good", F.posexplode("v").alias("rule", "value"))
    counts = each.groupBy("stratum", "rule", "value").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lost, caught = (F.coalesce(F.sum(c).over(above), F.lit(0)) for c in "gb")
    seen = counts.select("*", lost.alias("lost"), caught.alias("caught"), F.sum("g").over(whole).alias("ng"), F.sum("b").over(whole).alias("nb"))
    gain = F.col("caught").cast("decimal(19,0)") * F.col("ng") - F.col("lost").cast("decimal(19,0)") * F.col("nb")
    seen = seen.withColumn("gain", gain).where("gain > 0")
    cuts = []
    for i, (allowed, percent) in enumerate(levels):
        here = F.col("lost") * 1000 <= F.col("ng") * allowed
        seen = seen.withColumn(f"best{i}", F.max(F.when(here, F.col("gain"))).over(whole))
        cuts.append(F.max(F.when(here & (F.col("gain") * 100 >= F.col(f"best{i}") * percent), F.col("value"))))
    found = seen.groupBy("stratum", "rule").agg(F.array(*cuts).alias("cuts"))
    rules = [F.max(F.when(F.col("rule") == i, F.col("cuts"))) for i in range(len(RULES))]
    by_level = F.array(*(F.array(*(F.get(r, F.lit(i)) for r in rules)) for i in range(len(levels))))
    return found.groupBy("stratum").agg(by_level.alias("proposed"))


def _broken(v: Column, cuts: Column) -> Column:
    """Flags of the rules whose statistic is above their cutoff."""
    return F.array(*(F.coalesce(F.get(v, F.lit(i)) > F.get(cuts, F.lit(i)), F.lit(False)) for i in range(len(RULES))))


def certify(holdout: DataFrame, risk: float = RISK, delta: float = DELTA, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """stratum, n, level and cuts (null at level 0) of each stratum of rows (stratum, good, first, v).

    Rejected texts are counted where the rows lie, one row for each stratum and task; the exact tests run
    over the strata's rows, one after another, on executors.
    """
    cuts = durable(proposals(holdout.where("first"), levels).withColumnRenamed("stratum", "_of"), "quality-proposals")
    good = holdout.where("good AND NOT first").join(cuts, F.col("stratum").eqNullSafe(F.col("_of")), "left")
    ks = [F.count_if(F.exists(_broken(F.col("v"), F.get("proposed", F.lit(i))), lambda x: x)).alias(f"k{i}") for i in range(len(levels))]
    per = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *ks)
    per = durable(per, "quality-strata")  # a row for each stratum
    per = per.withColumn("strata", F.lit(per.count()))
    schema = T.StructType([T.StructField("stratum", T.StringType()), T.StructField("n", T.LongType()), T.StructField("level", T.IntegerType())])

    def make():
        def fn(stratum, n, strata, *ks):
            return stratum, n, [certified(*x, risk, delta) for x in zip(n, zip(*ks, strict=True), strata, strict=True)]

        return fn

    told = map_rows(per, ["stratum", "n", "strata", *(f"k{i}" for i in range(len(levels)))], make, schema)
    told = told.join(cuts, F.col("stratum").eqNullSafe(F.col("_of")), "left")
    return told.select("stratum", "n", "level", F.when(F.col("level") > 0, F.get("proposed", F.col("level") - 1)).alias("cuts"))


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """A row (stratum, good, first, v) for each text of each stratum, from rows (stratum, good, mark, v).

    mark is the text's hash. A text is good only if all of its labelled copies are, and its hash tells its half.
    Copies are brought together where they lie first, so a text of many copies sends a row for each task.
    """
    once = labelled.groupBy("stratum", "mark").agg(F.min("good").alias("good"), F.first("v").alias("v"))
    return once.select("stratum", "good", (F.substring("mark", 1, 1) < "8").alias("first"), "v")


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """certify() on the labelled texts among counted."""
    told = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    labelled = counted.where(~base_failed()).join(told.withColumnRenamed("doc_id", "_labelled"), F.col("_id") == F.col("_labelled"))
    holdout = durable(distinct_texts(labelled.select("stratum", "good", "mark", statistics().alias("v"))), "quality-holdout")
    return durable(certify(holdout, risk, delta).withColumnRenamed("stratum", "_of"), "quality-cutoffs")


def with_cuts(rows: DataFrame, cuts: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the cutoffs of their stratum, if it has any: broadcast where they are small, else copied to PARTS
    parts, to which the rows of each stratum are dealt."""
    same = F.col("stratum").eqNullSafe(F.col("_of"))
    if small_enough(cuts, 128, limit):
        return rows.join(F.broadcast(cuts), same, "left")
    parts = cuts.withColumn("_part_of", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    return dealt.join(parts, same & (F.col("_part") == F.col("_part_of")), "left").drop("_part", "_part_of")


def broken_rules() -> Column:
    """Names of the rules that a row breaks at its stratum's cutoffs; none without them."""
    flags = _broken(statistics(), F.col("cuts"))
    return F.array_compact(F.array(*(F.when(F.get(flags, F.lit(i)), F.lit(r)) for i, r in enumerate(RULES))))


def _counted(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """_id, stratum, mark (the text's hash) and COUNTS of every row."""
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(stratum_col).cast("string").alias("stratum"), F.md5(F.encode(text, "UTF-8")).alias("mark"), text.alias("_text"))
    return with_counts(slim, ["_id", "stratum", "mark"], "_text").select("_id", "stratum", "mark", "_counts.*")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Verdict of every row of docs: doc_id, COUNTS, base_failed, broken (the certified rules that it
    breaks, in order) and kept.

    A null or empty text has no words and fails the base. Rows with a null id or a null stratum are
    judged like any other; unlabelled ids and labels without a document or a quality do not count as
    holdouts. Repeated rows each get their verdict, and count as one holdout, as do all labelled copies of a text
    in a stratum. If a label is repeated, the document is good only if all of its labels say so. Long texts are
    counted whole. Empty docs give an empty result, empty labels no cutoffs. Columns other than those named are
    neither read nor returned, and may have any name.
    """
    counted = _counted(docs, id_col, text_col, stratum_col)
    counted = durable(counted, "quality-counts")
    cuts = cutoffs(counted, labels, risk, delta)
    return (
        with_cuts(counted, cuts)
        .select(F.col("_id").alias("doc_id"), *COUNTS, base_failed().alias("base_failed"), broken_rules().alias("broken"))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns; cases as there.

    The verdict is a function of text and stratum, so the second pass counts each text again on its
    way through; no text is shuffled, and repeated or missing ids need no care.
    """
    counted = _counted(docs, id_col, text_col, stratum_col)
    cuts = cutoffs(counted, labels, risk, delta)
    columns = docs.columns
    named = docs.select(F.struct(*columns).alias("_row"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("_text"))
    judged = with_counts(named, ["_row", "stratum"], "_text").select("_row", "stratum", "_counts.*")
    return with_cuts(judged, cuts).where(~base_failed() & (F.size(broken_rules()) == 0)).select("_row.*")
