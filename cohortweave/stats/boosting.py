"""Propensity scores by gradient-boosted trees, tuning and importance."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import sqrt

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortweave.session import ensure_checkpoint_dir
from cohortweave.stats.features import Design

# Learning rates, depths and node sizes searched, and the final fit.
LEARNING_RATES = [0.3, 0.1, 0.05, 0.01, 0.005]
DEPTHS = [2, 3, 5, 7]
NODE_SIZES = [10, 20, 30, 50, 75, 100, 150]
FINAL_PARAMS = {"trees": 2000, "depth": 2, "shrinkage": 0.005, "min_node": 100}


def _classifier(params: Mapping[str, float], weight: str | None, seed: int) -> GBTClassifier:
    gbt = GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=int(params["trees"]), maxDepth=int(params["depth"]),
                        stepSize=float(params["shrinkage"]), minInstancesPerNode=int(params["min_node"]),
                        subsamplingRate=float(params.get("bag", 0.5)), maxBins=int(params.get("bins", 64)),
                        checkpointInterval=10, seed=seed)
    return gbt.setWeightCol(weight) if weight else gbt


def _training(df: DataFrame, treat: str, design: Design, extra: Sequence[str] = ()) -> DataFrame:
    return design.rows(df).select(F.col(treat).cast("double").alias("_y"), design.vector().alias("_x"), *extra)


def fit_gbt(df: DataFrame, treat: str, design: Design, params: Mapping[str, float], weight: str | None = None,
            seed: int = 13) -> GBTClassificationModel:
    ensure_checkpoint_dir(df.sparkSession)
    extra = [F.col(weight).cast("double").alias(weight)] if weight else []
    data = _training(df, treat, design, extra).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _classifier(params, weight, seed).fit(data)
    finally:
        data.unpersist()


def ps_gbt(df: DataFrame, treat: str, design: Design, params: Mapping[str, float], name: str = "pd",
           weight: str | None = None, seed: int = 13) -> tuple[DataFrame, GBTClassificationModel]:
    """Add the boosted treatment probability; returns the frame and the model."""
    model = fit_gbt(df, treat, design, params, weight, seed)
    scored = model.transform(design.rows(df).withColumn("_x", design.vector())).withColumn(
        name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
    return scored, model


def tune_gbt(df: DataFrame, treat: str, design: Design, grid: Sequence[Mapping[str, float]], row_key: str,
             folds: int = 10, seed: int = 723, parallelism: int = 4) -> list[dict]:
    """Cross-validated deviance for every parameter set, at its best number of trees.

    One fit per fold yields the deviance after every tree.  Folds come from a hash of
    the row key.  Result rows: the parameters, ``score`` = sqrt(min deviance),
    ``best_trees`` and ``seconds``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(row_key)), F.lit(folds)).cast("int")
    data = _training(df, treat, design, [fold.alias("_fold")]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["_fold"]: r["count"] for r in data.groupBy("_fold").count().collect()}

        def one(job: tuple[Mapping[str, float], int]) -> list[float]:
            params, k = job
            model = _classifier(params, None, seed).fit(data.where(F.col("_fold") != k))
            return model.evaluateEachIteration(data.where(F.col("_fold") == k))

        out = []
        for params in grid:
            began = time.time()
            with ThreadPoolExecutor(parallelism) as pool:
                paths = list(pool.map(one, [(params, k) for k in sorted(sizes)]))
            total = sum(sizes.values())
            path = [sum(p[i] * sizes[k] for p, k in zip(paths, sorted(sizes))) / total for i in range(len(paths[0]))]
            best = min(range(len(path)), key=lambda i: (path[i], i))
            out.append({**params, "score": sqrt(path[best]), "best_trees": best + 1, "seconds": time.time() - began})
        return out
    finally:
        data.unpersist()


def best_params(results: Sequence[Mapping[str, float]]) -> dict:
    """Lowest score; ties go to the fewest trees."""
    best = min(results, key=lambda r: (r["score"], r["best_trees"]))
    return {**{k: v for k, v in best.items() if k not in ("score", "best_trees", "seconds", "at_limit")},
            "trees": best["best_trees"]}


def importance(df: DataFrame, model: GBTClassificationModel, design: Design,
               labels: Mapping[str, str] | None = None) -> DataFrame:
    """Relative influence (percent, > 0) per variable: its columns' importances summed."""
    total: dict[str, float] = {}
    for variable, value in zip(design.variables, model.featureImportances.toArray()):
        total[variable] = total.get(variable, 0.0) + 100.0 * float(value)
    rows = [(v, (labels or {}).get(v, v), x) for v, x in total.items()]
    return (df.sparkSession.createDataFrame(rows, "variable string, label string, rel_inf double")
            .where("rel_inf > 0").orderBy(F.col("rel_inf").desc(), "variable"))
