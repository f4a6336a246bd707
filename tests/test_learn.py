"""Regression on data with known answers, nulls and a constant feature included."""

from pyspark.sql import functions as F

from tessera.operators import learn as L


def data(spark):
    x, z = (F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")
    rows = spark.range(400).select("id", x.alias("x"), z.alias("z"), F.lit(1.0).alias("same"), (3 + 2 * x - z).alias("y"))
    return rows.unionByName(spark.sql("select 400L as id, 1D as x, 1D as z, 1D as same, cast(null as double) as y union all select 401L, cast(null as double), 1D, 1D, 4D"))


def test_linear_is_exact(spark):
    got = {r.feature: r for r in L.train_eval(data(spark), ["x", "z", "same"], "y", F.col("id") % 4 > 0).collect()}
    assert abs(got["x"].weight - 2) < 1e-6 and abs(got["z"].weight + 1) < 1e-6 and got["same"].weight == 0
    assert got["x"].rmse == 0 and got["x"].r2 == 1
    line = L.line_fit(data(spark).withColumn("y", 3 + 2 * F.col("x")), "x", "y", F.col("id") % 4 > 0).first()
    assert abs(line.slope - 2) < 1e-9 and abs(line.intercept - 3) < 1e-9 and line.rmse < 1e-9


def test_forest_finds_the_step(spark):
    rows = data(spark).withColumn("y", F.when(F.col("x") > 8, 10.0).otherwise(0.0))
    got = L.train_eval(rows, ["z", "x"], "y", F.col("id") % 4 > 0, forest=True).collect()
    assert got[0].feature == "x" and got[0].weight > 0.9 and got[0].r2 > 0.9
    assert [tuple(r) for r in L.train_eval(rows, ["z", "x"], "y", F.col("id") % 4 > 0, forest=True).collect()] == [tuple(r) for r in got]


def test_forest_grows_from_sums_of_equal_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L.RandomForestRegressor, "fit", lambda self, rows, old=L.RandomForestRegressor.fit: seen.append(rows.count()) or old(self, rows))
    rows = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z")).withColumn("y", F.col("x") * 2 + F.col("id") % 11)
    few, whole = (L.train_eval(rows, ["x", "z"], "y", F.col("id") % 4 > 0, forest=True, **how).collect() for how in ({}, {"cells": 5}))
    assert len(seen) == L.TREES + 1 and max(seen[:-1]) <= 21 and seen[-1] == 1500
    assert [r.feature for r in few] == [r.feature for r in whole] and abs(few[0].rmse - whole[0].rmse) < 0.1 and abs(few[0].r2 - whole[0].r2) < 0.05
