"""What a NULL means in a design: its own level, a dropped row, or an error that names the column."""

import pytest
from pyspark.sql import functions as F

from cohortweave.stats import features as X, weights as W


def test_missing_rules(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], None if i % 11 == 0 else float(i % 5), int(i * 7919 % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, g string, x double, y int")
    d = X.design(df, [X.Term("g", "category", ref="a")])
    assert d.names == ["g=b", "g missing"]
    sums = df.agg(*[F.sum(c).alias(n) for n, c in zip(d.names, d.columns)]).first()
    assert sums["g missing"] == 29 and sums["g=b"] == sum(r[1] == "b" for r in rows)
    with pytest.raises(ValueError, match="x: 19 rows without a value"):
        X.design(df, [X.Term("x")])
    dropped = X.design(df, [X.Term("x", missing="drop"), X.Term("g", "category", ref="a")])
    assert W.ps_logistic(df, "y", dropped).count() == 181
    with pytest.raises(ValueError, match="outside the declared levels"):
        X.design(df, [X.Term("g", "category", levels=["a"])])
    with pytest.raises(ValueError, match="unknown rule"):
        X.design(df, [X.Term("x", missing="level")])
    monkeypatch.setattr(X, "MAX_FREE_LEVELS", 1)
    with pytest.raises(ValueError, match="declare"):
        X.design(df, [X.Term("g", "category")])
