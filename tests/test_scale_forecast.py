"""Series of a batch are forecast together, each as if it were alone."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from bankrec.operators import boosting, recursions


@pytest.mark.parametrize("model", [recursions.holt, recursions.arima, recursions.markov])
def test_a_batch_gives_what_each_series_gets_alone(spark, model):
    rng = np.random.default_rng(6)
    rows = [rng.normal(0, 9, n).cumsum().tolist() for n in (5, 40, 7, 40, 23, 6)] + [[3.0] * 9, [1.0, 2.0, 3.0], [1.0, float("nan"), 2.0, 5.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, y array<double>")
    read = lambda parts: {r.i: r.m for r in df.repartition(parts, "i").select("i", F.expr(model("y", 3)).alias("m")).collect()}
    together, apart = read(1), read(40)
    for i in range(len(rows)):
        assert together[i].falha == apart[i].falha and (together[i].falha is None) == (together[i].valores is not None)
        if together[i].valores is not None:
            assert together[i].valores == pytest.approx(apart[i].valores, rel=1e-9, abs=1e-9)
    assert together[8].falha is not None
    # no fold is left to be interpreted row by row
    assert "aggregate(" not in df.select(F.expr(model("y", 3)))._jdf.queryExecution().optimizedPlan().toString()


def test_means_are_not_computed_again_for_each_value(spark):
    rows = spark.createDataFrame([("a", [float(i % 7) for i in range(20)])], "serie string, valores array<double>").withColumn(
        "ultimo", F.current_date())
    scaled = boosting.scaled(rows)
    plan = scaled.select(F.explode("valores"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2
    values = np.array([float(i % 7) for i in range(20)])
    got = scaled.first()
    assert (got.centro, got.desvio) == (pytest.approx(values.mean()), pytest.approx(values.std()))
    assert got.valores == pytest.approx((values - values.mean()) / values.std())
