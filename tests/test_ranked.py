"""Ranks and running totals equal their plain definitions, whatever the skew and partitioning."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import salted_sha
from tessera.operators.ranked import nearest_value, ranked, ranked_by_value, ranked_sides, running_total


def skewed(spark, n=3000):
    """Two thirds of all rows in one group, NULL keys and one very common value."""
    d = spark.range(n).withColumn("g", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 5)))
    return d.withColumns({"h": salted_sha("s", "id"), "v": F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.pmod(F.hash("id"), F.lit(50)).cast("double"))})


def test_ranked_equals_definition_and_ignores_order(spark):
    d = skewed(spark)
    for df in (d, d.repartition(13, "v").orderBy("v")):
        p = ranked(df, ["g"], "h", size="n").toPandas()
        want = p.groupby("g", dropna=False)["h"].rank(method="first").astype(int)
        assert (want == p["rank"]).all()
        assert (p.groupby("g", dropna=False)["id"].transform("count") == p["n"]).all()


def test_ranked_without_groups(spark):
    p = ranked(skewed(spark), [], "h").toPandas().sort_values("h")
    assert list(p["rank"]) == list(range(1, len(p) + 1))


def test_ranked_sides(spark):
    d = skewed(spark).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    p = ranked_sides(d, ["g"], "y", "h").toPandas()
    assert (p.groupby(["g", "y"], dropna=False)["h"].rank(method="first").astype(int) == p["rank"]).all()
    assert (p["y"].eq(1).groupby(p["g"], dropna=False).transform("sum") == p["n1"]).all()


def test_ranked_by_value_descending(spark):
    p = ranked_by_value(skewed(spark), ["g"], "v", "h", descending=True).toPandas()
    p = p.sort_values(["g", "v", "h"], ascending=[True, False, True])
    assert (p.groupby("g", dropna=False).cumcount() + 1 == p["rank"]).all()


def test_running_total(spark):
    d = skewed(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    p = running_total(d, ["g"], "v", {"c": F.col("c")}).toPandas().sort_values(["g", "v"])
    before = p.groupby("g", dropna=False)["c"].cumsum() - p["c"]
    assert (before == p["c_before"]).all()
    assert (p.groupby("g", dropna=False)["c"].transform("sum") == p["c_total"]).all()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=20), st.lists(st.integers(-50, 50), min_size=1, max_size=20))
def test_nearest_value(spark, asks, pool):
    q = spark.createDataFrame(pd.DataFrame({"k": range(len(asks)), "g": "a", "v": asks}))
    p = spark.createDataFrame(pd.DataFrame({"g": "a", "v": pool}))
    got = {r["k"]: r["gap"] for r in nearest_value(q, p, ["g"], "v").collect()}
    assert got == {k: float(min(abs(v - x) for x in pool)) for k, v in enumerate(asks)}


def test_negative_zero_is_zero_in_keys(spark):
    from tessera.operators.joins import same_key_join

    a = spark.createDataFrame([(-0.0, 1), (0.0, 2), (None, 3)], "k double, i int")
    b = spark.createDataFrame([(0.0, "z"), (None, "n")], "k double, v string")
    assert {r["i"]: r["v"] for r in same_key_join(a, b, ["k"]).collect()} == {1: "z", 2: "z", 3: "n"}
