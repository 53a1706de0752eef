"""Fitted models: MLlib for generalised linear models and trees, a closed-form ridge by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.sources.tables import stored


def prepared(names: Sequence[str]) -> list:
    """Medians for missing values, one vector, scaled."""
    filled = [f"{n}_f" for n in names]
    return [
        Imputer(strategy="median", inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def estimator(kind: str, seed: int = 42):
    if kind == "poisson":
        return GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", regParam=1e-3, maxIter=25)
    if kind == "tweedie":
        return GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="y", regParam=1e-3, maxIter=25)
    if kind == "forest":
        return RandomForestRegressor(labelCol="logged", numTrees=100, maxDepth=12, seed=seed)
    raise ValueError(f"unknown model {kind}")


def dealt(train: DataFrame) -> DataFrame:
    """train, made once for all passes of a fit and dealt over two tasks a core, in an order of its own values.

    A pass costs far more than its rows' bytes, by which Spark would put them into a few tasks. More
    tasks than that cost as well, as each has the statistics of all nodes of a pass.
    """
    n = 2 * train.sparkSession.sparkContext.defaultParallelism
    return stored(train, "training").repartition(n, *train.columns).sortWithinPartitions(*train.columns)


def fit_predict(train: DataFrame, test: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """test with pred; the forest learns log1p of the target. Forecasts are not negative."""
    logged = kind == "forest"
    model = Pipeline(stages=[*prepared(names), estimator(kind)]).fit(dealt(train.withColumn("logged", F.log1p("y"))))
    out = model.transform(test)
    pred = F.expm1("prediction") if logged else F.col("prediction")
    return out.select(*test.columns, F.greatest(pred, F.lit(0.0)).alias("pred"))


def residual_on(train: DataFrame, test: DataFrame, names: Sequence[str], base: str) -> DataFrame:
    """base plus what trees learn of its errors."""
    stages = [*prepared(names), GBTRegressor(labelCol="residual", maxIter=10, maxDepth=3, seed=42)]
    out = Pipeline(stages=stages).fit(dealt(train.withColumn("residual", F.col("y") - F.col(base)))).transform(test)
    return out.select(*test.columns, F.greatest(F.col(base) + F.col("prediction"), F.lit(0.0)).alias("pred"))


def ridge_sums(df: DataFrame, names: Sequence[str], y: str, keys: Sequence[str]) -> DataFrame:
    """The normal equations of every group as columns: one pass with map-side sums, whatever the group's size."""
    n = len(names)
    cells = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(n) for j in range(i, n)]
    sums = [F.sum(c) for c in names]
    right = [F.sum(F.col(c) * F.col(y)) for c in names]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("xx"), F.array(*sums).alias("x"), F.array(*right).alias("xy"), F.sum(y).alias("y"))


def ridge(df: DataFrame, names: Sequence[str], y: str, keys: Sequence[str], penalty: float) -> DataFrame:
    """Ridge of every group on standardised columns, free intercept: keys, intercept, weights (of the raw columns)."""
    k = len(names)

    def solve(batches):
        import numpy as np
        import pandas as pd

        upper = np.triu_indices(k)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                xx = np.zeros((k, k))
                xx[upper] = r.xx
                xx = xx + np.triu(xx, 1).T
                mean, total = np.array(r.x) / r.n, r.y / r.n
                spread = np.sqrt(np.maximum(np.diag(xx) / r.n - mean**2, 1e-12))
                a = (xx / r.n - np.outer(mean, mean)) / np.outer(spread, spread)
                w = np.linalg.solve(a + penalty / r.n * np.eye(k), (np.array(r.xy) / r.n - mean * total) / spread) / spread
                out.append((*[getattr(r, c) for c in keys], float(total - w @ mean), w.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "intercept", "weights"])

    sums = ridge_sums(df, names, y, keys)
    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)
    return sums.mapInPandas(solve, f"{kinds}, intercept double, weights array<double>")


def reduced(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """df with its first k principal components."""
    stages = [*prepared(names), PCA(k=k, inputCol="features", outputCol="components")]
    return Pipeline(stages=stages).fit(df).transform(df).select(*df.columns, "components")


def quantile_line(df: DataFrame, x: str, y: str, key: str, q: float, bins: int = 20) -> DataFrame:
    """The q-quantile of y as a line in x, for every group: a line through the quantiles of equal bins of x.

    Bins bound what a line is fitted to, whatever the group's size; each bin weighs as its rows.
    """
    ends = df.groupBy(key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    place = F.least(F.floor(F.try_divide(F.col(x) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    b = df.join(ends, key).withColumn("bin", F.coalesce(place, F.lit(0))).groupBy(key, "bin").agg(F.avg(x).alias("u"), F.percentile(y, q).alias("v"), F.count(F.lit(1)).alias("n"))
    mean = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    u, v = F.col("u"), F.col("v")
    m = b.groupBy(key).agg(mean(u).alias("mu"), mean(v).alias("mv"), mean(u * v).alias("uv"), mean(u * u).alias("uu"))
    slope = F.coalesce(F.try_divide(F.col("uv") - F.col("mu") * F.col("mv"), F.col("uu") - F.col("mu") * F.col("mu")), F.lit(0.0))
    return m.select(key, (F.col("mv") - slope * F.col("mu")).alias("intercept"), slope.alias("slope"))
