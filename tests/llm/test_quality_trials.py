"""Quality rules: copies of a text are one trial, statistics have no upper end, cutoffs of any size join evenly."""

import random

from pyspark.sql import functions as F

from stintline.llm import quality_rules

COLUMNS = "doc_id long, text string, lang string, quality int"


def rows(n, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(30)]
        out.append((i, " ".join(w + ("***" if bad else "") for w in words), "en" if i % 3 else "de", 0 if bad else 1))
    return out


def told(spark, table):
    counted = quality_rules._counted(table, "doc_id", "text", "lang")
    return {r["_of"]: (r["n"], r["level"], r["cuts"]) for r in quality_rules.cutoffs(counted, table.select("doc_id", "quality"), 0.03, 0.05).collect()}


def test_copies_are_one_trial(spark):
    few = rows(500)
    copies = [(1000 * k + i, *rest) for k in range(10) for i, *rest in few]
    once, often = told(spark, spark.createDataFrame(few, COLUMNS)), told(spark, spark.createDataFrame(copies, COLUMNS))
    assert once == often and set(once) == {"en", "de"}
    # as many different texts reach further
    many = told(spark, spark.createDataFrame(rows(5000), COLUMNS))
    assert many["en"][0] > often["en"][0] and many["en"][1] > often["en"][1]


def test_one_bad_copy_makes_a_text_bad_and_halves_follow_texts(spark):
    schema = "stratum string, good boolean, mark string, v array<bigint>"
    table = spark.createDataFrame([("a", True, "1f", [1]), ("a", False, "1f", [1]), ("b", True, "1f", [1]), ("a", True, "9e", [2]), (None, True, "9e", [2]), (None, True, "9e", [2])], schema)
    got = sorted(map(tuple, quality_rules.distinct_texts(table).collect()), key=repr)
    assert got == sorted([("a", False, True, [1]), ("b", True, True, [1]), ("a", True, False, [2]), (None, True, False, [2])], key=repr)


def test_statistics_have_no_upper_end(spark):
    values = [*range(0, 40), 8190, 8191, 8192, 8193, 16383, 16384, 16387, 10**6 + 7, 2**40 + 2**20 + 1]
    table = spark.createDataFrame([(v, *([v] * len(quality_rules.COUNTS))) for v in values], ", ".join(f"{c} long" for c in ["_id", *quality_rules.COUNTS]))
    table = table.withColumn("n_words", F.lit(1).cast("long")).withColumn("n_marks", F.col("_id"))
    marks = list(quality_rules.RULES).index("marks")
    low, high = (list(quality_rules.RULES).index(f"{x}_words") for x in ("short", "long"))
    for r in table.select("_id", quality_rules.statistics().alias("v")).collect():
        whole = r["_id"] * 1000
        digits = max(0, whole.bit_length() - quality_rules.DIGITS)
        assert r["v"][marks] == whole >> digits << digits
        assert r["v"][low] == -r["v"][high]
    got = [r["v"][marks] for r in table.orderBy("_id").select(quality_rules.statistics().alias("v")).collect()]
    assert got == sorted(got) and got[-1] > got[-2] > 999 * 10**6


def test_a_cutoff_may_lie_beyond_eight_marks_a_word(spark):
    rng = random.Random(9)
    made = []
    for i in range(1600):
        bad = i % 4 == 0
        words = ["".join(rng.choices("abcdefghij", k=6)) + ("!" * (rng.randint(20, 30) if bad else rng.randint(9, 12))) for _ in range(20)]
        made.append((i, " ".join(words), "en", 0 if bad else 1))
    table = spark.createDataFrame(made, COLUMNS)
    out = quality_rules.quality_rules(table, table.select("doc_id", "quality")).join(table.select("doc_id", "quality"), "doc_id")
    assert out.where("quality = 0 AND kept").count() == 0 and out.where("quality = 1 AND kept").count() > 1150


def test_cutoffs_beyond_the_broadcast_bound_are_dealt(spark):
    cuts = spark.createDataFrame([("a", 5, [1]), (None, 6, [2])], "_of string, n long, cuts array<bigint>")
    table = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("a")).otherwise(F.lit("z")).alias("stratum"))
    small, large = quality_rules.with_cuts(table, cuts), quality_rules.with_cuts(table, cuts, limit=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.columns == large.columns
    assert "_part_of" in large._jdf.queryExecution().optimizedPlan().toString()
