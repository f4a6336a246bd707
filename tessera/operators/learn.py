"""Regression on a table with a reproducible split."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.io import cut_lineage

#: Distinct feature vectors up to which a forest is grown from sums over them, its trees, and how many are grown at a time.
CELLS, TREES, FITS = 1 << 14, 50, 8


def line_fit(df: DataFrame, x: str, y: str, train: Column) -> DataFrame:
    """Slope, intercept and the error on the other rows of a least-squares line, from two aggregations."""
    slope, intercept = df.where(train).agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    miss = F.col(y) - (F.lit(slope) * F.col(x) + F.lit(intercept))
    rest = df.where(~train).agg(F.count("*").alias("rows"), F.sqrt(F.avg(miss * miss)).alias("rmse"))
    return rest.select(F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"), "rows", "rmse")


def train_eval(df: DataFrame, features: list[str], target: str, train: Column, forest: bool = False, seed: int = 42, cells: int = CELLS) -> DataFrame:
    """(model, rmse, r2, feature, weight): linear regression, or a forest of 50 trees with its five most important features.

    A forest over up to ``cells`` distinct feature vectors is grown from sums over them, which a bagged row enters once, else from the rows.
    """
    if forest and len(df.where(F.col(target).isNotNull()).select(*features).na.drop().distinct().limit(cells + 1).collect()) <= cells:
        rmse, r2, weights = _cell_forest(df, features, target, train, seed)
    else:
        vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.where(F.col(target).isNotNull()))
        learner = RandomForestRegressor(numTrees=TREES, seed=seed, labelCol=target) if forest else LinearRegression(labelCol=target)
        model = learner.fit(vectors.where(train))
        found = model.transform(vectors.where(~train))
        rmse, r2 = (RegressionEvaluator(labelCol=target, metricName=name).evaluate(found) for name in ("rmse", "r2"))
        weights = model.featureImportances.toArray() if forest else model.coefficients.toArray()
    best = sorted(zip(features, map(float, weights), strict=True), key=lambda p: -abs(p[1]))[:5]
    rows = [("forest" if forest else "linear", round(rmse, 4), round(r2, 4), name, weight) for name, weight in best]
    return df.sparkSession.createDataFrame(rows, "model string, rmse double, r2 double, feature string, weight double")


def _bagged(rows: DataFrame, features: list[str], target: str, seed: int) -> DataFrame:
    """(tree, features, n, mean): of every tree and distinct feature vector, how often its rows were drawn (Poisson of mean 1 for each row and tree) and their mean target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, place, sums = np.random.default_rng([seed, TaskContext.get().partitionId()]), {}, np.zeros((0, 2, TREES))
        for b in batches:
            if not b.num_rows:
                continue
            x, y = np.column_stack([c.to_numpy() for c in b.columns[:-1]]), b.columns[-1].to_numpy()
            order = np.lexsort(x.T)
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))))
            times = draw.poisson(1.0, (len(y), TREES)).astype(np.float64)
            at = np.array([place.setdefault(tuple(v), len(place)) for v in x[first].tolist()])
            sums = np.concatenate((sums, np.zeros((len(place) - len(sums), 2, TREES))))
            sums[at, 0] += np.add.reduceat(times, first)
            sums[at, 1] += np.add.reduceat(times * y[:, None], first)
        vectors = np.array(list(place), dtype=np.float64).reshape(len(place), len(features))
        for t in range(TREES if place else 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), t, np.int32)), *[pa.array(v) for v in vectors.T], pa.array(sums[:, 0, t]), pa.array(sums[:, 1, t])], names)

    names = ["tree", *[f"x{i}" for i in range(len(features))], "n", "total"]
    drawn = rows.select(*[F.col(c).cast("double") for c in [*features, target]]).mapInArrow(run, ", ".join(f"{c} {'int' if c == 'tree' else 'double'}" for c in names))
    whole = drawn.groupBy(names[:-2]).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    return whole.select(*names[:-1], (F.col("total") / F.col("n")).alias("mean"))


def _cell_forest(df: DataFrame, features: list[str], target: str, train: Column, seed: int) -> tuple[float, float, np.ndarray]:
    """rmse, r2 and importances of a forest grown from sums of distinct feature vectors.

    A split depends on the rows of a node only by their number and sum of targets on each side, so a tree over the vectors, each with the
    weight and mean of its drawn rows, is the tree over the drawn rows themselves.
    """
    known = df.where(F.col(target).isNotNull()).na.drop(subset=features)
    names = [f"x{i}" for i in range(len(features))]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    bags = cut_lineage(_bagged(known.where(train), features, target, seed).repartition(TREES, "tree"))
    learner = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird" if len(features) > 1 else "all", labelCol="mean", weightCol="n")
    y = F.col(target).cast("double")
    asked = known.where(~train).select(*[F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)], y.alias("y"))
    cells = cut_lineage(assembler.transform(asked.groupBy(names).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).coalesce(1)))
    found, weights = cells.withColumn("told", F.lit(0.0)), np.zeros(len(features))
    fit = lambda t: learner.copy().setSeed(seed + t).setPredictionCol("one").fit(assembler.transform(bags.where(F.col("tree") == t).coalesce(1)))
    with ThreadPoolExecutor(FITS) as pool:  # small jobs of one task each
        models = list(pool.map(fit, range(TREES)))
    for model in models:
        weights += model.featureImportances.toArray()
        found = model.transform(found).withColumn("told", F.col("told") + F.col("one") / TREES).drop("one")
    n, s, q, miss = found.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.sum(F.col("q") - 2 * F.col("told") * F.col("s") + F.col("n") * F.col("told") * F.col("told"))).first()
    spread = q - s * s / n
    return (miss / n) ** 0.5, 1 - miss / spread if spread else float("nan"), weights / (weights.sum() or 1.0)
