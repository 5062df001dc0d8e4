"""Propensity scores by logistic regression, and inverse-probability weights."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame, functions as F

from cohortweave.stats.features import Design


def ps_saturated(df: DataFrame, treat: str, by: Sequence[str], name: str = "pd") -> DataFrame:
    """Propensity score of a fully saturated category model: the group share."""
    shares = df.groupBy(*by).agg(F.avg(F.col(treat).cast("double")).alias(name))
    return df.join(shares, list(by))


def fit_logistic(df: DataFrame, treat: str, design: Design, weight: str | None = None,
                 max_iter: int = 25) -> GeneralizedLinearRegressionModel:
    """Unpenalised binomial regression; the Gram matrices are summed on the executors."""
    cols = [F.col(treat).cast("double").alias("_y"), design.vector().alias("_x")]
    if weight:
        cols.append(F.col(weight).cast("double").alias("_w"))
    data = design.rows(df).select(*cols)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="_y", featuresCol="_x",
                                      predictionCol="_p", maxIter=max_iter, tol=1e-5, regParam=0.0)
    if weight:
        glm = glm.setWeightCol("_w")
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = glm.fit(data)
        if model.summary.numIterations >= max_iter:
            warnings.warn(f"logistic fit of {treat} did not converge in {max_iter} steps (separated groups?)", stacklevel=2)
        return model
    finally:
        data.unpersist()


def score(df: DataFrame, model: GeneralizedLinearRegressionModel, design: Design, name: str) -> DataFrame:
    return model.transform(design.rows(df).withColumn("_x", design.vector())).withColumnRenamed("_p", name).drop("_x")


def ps_logistic(df: DataFrame, treat: str, design: Design, name: str = "pd") -> DataFrame:
    """Add the fitted treatment probability."""
    return score(df, fit_logistic(df, treat, design), design, name)


def iptw(df: DataFrame, treat: str, pd: str = "pd", pn: str | None = None, name: str = "iptw") -> DataFrame:
    """Stabilised weight: pn/pd for the treated, (1-pn)/(1-pd) for the others.

    Without ``pn`` the numerator is the treated share of the whole frame.
    """
    if pn is None:
        pn = "pn"
        df = df.crossJoin(F.broadcast(df.agg(F.avg(F.col(treat).cast("double")).alias(pn))))
    n, d = F.col(pn), F.col(pd)
    return df.withColumn(name, F.when(F.col(treat) == 1, n / d).otherwise((1 - n) / (1 - d)))
