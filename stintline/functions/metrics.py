"""Scores of a generated text against a reference, as column expressions."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import close, let, numbers, ungrounded

#: Sizes of the n-grams that BLEU counts.
ORDERS = (1, 2, 3, 4)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the table's rows as the bits of one whole number of any length.

    A zero bit stands where a row's value rises along b, so that each token of a costs a few operations on the
    number, in proportion to the machine words that b takes.
    """
    marks: dict[str, int] = {}
    for i, t in enumerate(b):
        marks[t] = marks.get(t, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for t in a:
        hit = row & marks.get(t, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def clipped_hits(a: list[str], b: list[str]) -> list[int]:
    """For each of ORDERS, the n-grams of b that a has too, each at most as often. A gram is one number."""
    place = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]), 1)}
    x, y, base, out = [place[t] for t in a], [place[t] for t in b], len(place) + 1, []
    ga, gb = x, y
    for n in ORDERS:
        if n > 1:
            ga, gb = ([g * base + t for g, t in zip(grams, side[n - 1 :])] for grams, side in ((ga, x), (gb, y)))
        sa, sb = set(ga), set(gb)
        if len(sa) == len(ga) or len(sb) == len(gb):  # no gram twice on one side
            out.append(len(sa & sb))
        else:
            held = Counter(ga)
            out.append(sum(min(k, held[g]) for g, k in Counter(gb).items()))
    return out


def _of_pairs(count, kind: T.DataType, reference: Column, prediction: Column) -> Column:
    """count of two lists of tokens, in Arrow batches. Expressions over arrays would be interpreted, and a table of
    common subsequences copied row by row."""

    def run(r: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([count(x.split(" ") if x else [], y.split(" ") if y else []) for x, y in zip(r, p, strict=True)])

    joined = lambda t: F.coalesce(F.array_join(t, " "), F.lit(""))  # noqa: E731  tokens hold no blank
    return F.pandas_udf(run, kind)(joined(reference), joined(prediction))


def rouge_l(reference: Column, prediction: Column) -> Column:
    """F1 of the longest common subsequence of lower-cased tokens; 0 if either side is empty."""
    r, p = tokens(reference), tokens(prediction)
    found = _of_pairs(common_subsequence, T.IntegerType(), r, p)
    return F.when((F.size(r) == 0) | (F.size(p) == 0), 0.0).otherwise(2 * found.cast("double") / (F.size(r) + F.size(p)))


def bleu4(reference: Column, prediction: Column) -> Column:
    """BLEU with clipped n-grams up to four, no smoothing (any order without a hit gives 0), and brevity penalty."""
    r, p = tokens(reference), tokens(prediction)
    nr, np = F.size(r), F.size(p)
    found = _of_pairs(clipped_hits, T.ArrayType(T.IntegerType()), r, p)
    hits = [found[i] for i in range(len(ORDERS))]
    logs = reduce(lambda a, b: a + b, (F.log(h / (np - i)) for i, h in enumerate(hits)))
    penalty = F.when(np >= nr, 1.0).otherwise(F.exp(1 - nr / np))
    every = reduce(lambda a, b: a & b, (h > 0 for h in hits))
    return F.when((nr > 0) & (np > 3), F.when(every, penalty * F.exp(logs / 4)).otherwise(0.0)).otherwise(0.0)


def factual_of(r: Column, p: Column) -> Column:
    """Whether any predicted number (p) is close to any reference number (r); true without reference numbers."""
    return (F.size(r) == 0) | F.exists(r, lambda x: F.exists(p, lambda y: close(y, x)))


def hallucination_of(r: Column, p: Column) -> Column:
    """Share of predicted numbers that no reference number is close to; 0 if either side has none."""
    return F.when((F.size(r) == 0) | (F.size(p) == 0), 0.0).otherwise(F.size(ungrounded(p, r)) / F.size(p))


def _numbered(reference: Column, prediction: Column, of) -> Column:
    sides = F.struct(numbers(reference).alias("r"), numbers(prediction).alias("p"))
    return let(sides, lambda s: of(s["r"], s["p"]))


def factual(reference: Column, prediction: Column) -> Column:
    """factual_of() the numbers of two texts."""
    return _numbered(reference, prediction, factual_of)


def hallucination(reference: Column, prediction: Column) -> Column:
    """hallucination_of() the numbers of two texts."""
    return _numbered(reference, prediction, hallucination_of)


def grounded(reference: Column, prediction: Column) -> Column:
    """factual, halluc and fails_guard of two texts, whose numbers are read once."""
    return _numbered(reference, prediction, lambda r, p: F.struct(factual_of(r, p).alias("factual"), hallucination_of(r, p).alias("halluc"), (F.size(ungrounded(p, r)) > 0).alias("fails_guard")))


def score(pairs: DataFrame, reference: str = "reference", prediction: str = "generated") -> DataFrame:
    """pairs with all four scores and the numbers of both sides."""
    r, p = F.col(reference), F.col(prediction)
    told = _numbered(r, p, lambda x, y: F.struct(factual_of(x, y).alias("f"), hallucination_of(x, y).alias("h"), x.alias("r"), y.alias("p")))
    both = pairs.withColumn("_told", let(told, lambda t: t))
    return both.withColumns({"rouge_l": rouge_l(r, p), "bleu": bleu4(r, p), "factual": F.col("_told.f"), "halluc": F.col("_told.h"), "ref_nums": F.col("_told.r"), "pred_nums": F.col("_told.p")}).drop("_told")


def histogram(scored: DataFrame, column: str, buckets: int = 5) -> DataFrame:
    """Counts of a score of 0 to 1 in equal buckets; 1 falls in the last."""
    bucket = F.least(F.floor(F.col(column) * buckets), F.lit(buckets - 1)).cast("int")
    return scored.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def report(scored: DataFrame) -> DataFrame:
    """One row of means and shares."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("rouge_l").alias("rouge_l"), F.avg("bleu").alias("bleu"), F.avg(F.col("factual").cast("double")).alias("factual"), F.avg("halluc").alias("halluc"))


def rescored(saved: DataFrame, old: str = "halluc", reference: str = "reference", prediction: str = "generated") -> DataFrame:
    """Saved records with their hallucination and factual scores found again, and by how much the first fell."""
    r, p = F.col(reference), F.col(prediction)
    return saved.withColumns({"new_halluc": hallucination(r, p), "new_factual": factual(r, p)}).withColumn("improvement", F.col(old) - F.col("new_halluc"))


def extremes(scored: DataFrame, column: str, key: str, k: int, lowest: bool = True) -> DataFrame:
    """The k rows of the lowest (or highest) score for a report; ties go to the lower key."""
    return scored.orderBy(F.col(column).asc() if lowest else F.col(column).desc(), key).limit(k)


def report_lines(scored: DataFrame, key: str = "id", worst: int = 10) -> DataFrame:
    """place and line of the evaluation's report: means, distributions, worst pairs, and pairs whose
    numbers are wrong (at most `worst` of each), with how many there are. Every part is an aggregate or a limit."""
    number = lambda c, digits: F.round(c, digits).cast(f"decimal(18,{digits})").cast("string")
    means = report(scored)
    texts = [F.concat(F.lit("examples "), F.col("n").cast("string"))]
    texts += [F.concat(F.lit(f"{c} "), number(F.col(c), 4)) for c in ("rouge_l", "bleu", "factual", "halluc")]
    wrong = F.concat(F.lit("wrong numbers in "), F.round(F.col("n") * (1 - F.col("factual"))).cast("long").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    out = means.select(F.posexplode(F.array(*texts)).alias("place", "line"))
    for base, column in ((100, "rouge_l"), (200, "bleu")):
        bars = histogram(scored, column)
        label = F.concat(F.lit(f"{column} "), number(F.col("bucket") / 5, 1), F.lit("-"), number((F.col("bucket") + 1) / 5, 1), F.lit(" "), F.col("n").cast("string"))
        out = out.unionByName(bars.select((F.col("bucket") + base).alias("place"), label.alias("line")))
    rank = F.row_number().over(Window.orderBy("_by", key))  # over `worst` rows
    low = scored.withColumn("_by", F.round("rouge_l", 9)).orderBy("_by", key).limit(worst)
    out = out.unionByName(low.select((rank + 300).alias("place"), F.concat(F.lit("low "), F.col(key).cast("string"), F.lit(" "), number(F.col("rouge_l"), 3), F.lit(" "), number(F.col("bleu"), 3)).alias("line")))
    out = out.unionByName(means.select(F.lit(400).alias("place"), wrong.alias("line")))
    failed = scored.where("NOT factual").orderBy(key).limit(worst)
    place = F.row_number().over(Window.orderBy(key))
    return out.unionByName(failed.select((place + 400).alias("place"), F.concat(F.lit("wrong "), F.col(key).cast("string")).alias("line")))
