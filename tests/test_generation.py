"""Generation in rounds: stopped, failed and resumed, it ends with the rows of one run."""

import pytest
from pyspark.sql import functions as F

from stintline.operators import generation
from stintline.sources.versions import Versions


def pool(spark, n=120):
    rows = spark.range(n).select(F.concat(F.lit("c"), F.col("id") % 3).alias("category"), "id", F.lit("deg 0.050 s/lap, cliff lap 20").alias("facts"))
    return rows.where("id % 3 <> 2 OR id < 20")


def say(df):
    return df.withColumn("response", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 4 == 0, "the cliff is lap 99").otherwise("the cliff is lap 20"))


def shown(spark, root):
    return sorted(map(tuple, generation.tried(spark, root).collect()))


def test_rounds_and_quotas(spark, tmp_path):
    quotas = spark.createDataFrame([("c0", 12), ("c1", 0), ("c2", 500)], "category string, quota long")
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    generation.run(spark, one, pool(spark), quotas, say)
    assert generation.run(spark, one, pool(spark), quotas, say) == Versions(spark, one).current()  # nothing left to do
    generation.run(spark, two, pool(spark), quotas, say, rounds=1)
    with pytest.raises(Exception, match="stopped"):
        generation.run(spark, two, pool(spark), quotas, lambda df: df.withColumn("response", F.raise_error(F.lit("stopped"))))
    generation.run(spark, two, pool(spark), quotas, say, rounds=1)
    generation.run(spark, two, pool(spark), quotas, say)
    assert shown(spark, one) == shown(spark, two)
    got = {r["category"]: r.asDict() for r in generation.progress(generation.tried(spark, one)).collect()}
    assert got["c0"]["kept"] == 12 and "c1" not in got
    few = [i for i in range(20) if i % 3 == 2]  # all of c2 are tried, as it has too few
    assert got["c2"] == {"category": "c2", "kept": sum(i % 7 and i % 4 > 0 for i in few), "bad_format": sum(i % 7 == 0 for i in few), "ungrounded": sum(i % 7 > 0 and i % 4 == 0 for i in few)}
    tried = generation.tried(spark, one).where("category = 'c0'")
    assert tried.agg(F.max("place")).first()[0] == tried.count() == tried.select("id").distinct().count()


def test_nothing_to_try(spark, tmp_path):
    none = pool(spark).limit(0)
    generation.run(spark, f"file://{tmp_path}/none", none, spark.createDataFrame([("c0", 5)], "category string, quota long"), say)
    assert shown(spark, f"file://{tmp_path}/none") == []
