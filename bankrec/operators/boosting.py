"""Gradient boosting over the lag and calendar features, one fit for all series.

Values are scaled per series, so the trees learn shapes that series share. The fit and the
predictions are Spark's own; each step ahead is one more transform of the row, which carries
the last values of its series.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec.functions.values import FEATURE_LABELS, calendar, label
from bankrec.operators import series as s
from bankrec.operators.recursions import let
from bankrec.session import ensure_checkpoint_dir

BOOSTING = "gradient_boosting"
MIN_POINTS = 15
# Fixed values of the model.
TREES, DEPTH, RATE, ROW_SHARE, SEED = 6, 3, 0.5, 0.8, 42


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=s.FEATURES, outputCol="entrada")


def scaled(linhas: DataFrame) -> DataFrame:
    """Gathered series, long enough, with ``valores`` in units of their own spread."""
    mean = "aggregate(valores, 0D, (a, x) -> a + x) / size(valores)"
    spread = "sqrt(aggregate(valores, 0D, (a, x) -> a + (x - c) * (x - c)) / size(valores))"
    told = let(mean, "c", let(spread, "s", let("if(s > 0D, s, 1D)", "d", "struct(c as centro, d as desvio, transform(valores, x -> (x - c) / d) as valores)")))
    # a generator's columns are values: in projections the mean would be computed again for each value
    return linhas.where(f"size(valores) >= {MIN_POINTS}").selectExpr("serie", "ultimo", f"inline(array({told}))")


def fit(rows: DataFrame) -> GBTRegressionModel | None:
    """One model for all ``scaled`` series; null where there is none."""
    long = rows.select("serie", "ultimo", F.size("valores").alias("n"), F.posexplode("valores").alias("t", "valor")).select(
        "serie", "t", F.expr("date_sub(ultimo, n - 1 - t)").alias("dia"), "valor")
    ensure_checkpoint_dir(rows.sparkSession)
    # every tree reads the table several times; what a lost executor held is read again
    train = _assembler().transform(s.features(long)).select("entrada", "valor").checkpoint().persist()
    if train.isEmpty():
        return None
    model = GBTRegressor(featuresCol="entrada", labelCol="valor", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE,
                        subsamplingRate=ROW_SHARE, seed=SEED).fit(train)
    train.unpersist()
    return model


def ahead(rows: DataFrame, model: GBTRegressionModel, h: int) -> DataFrame:
    """``(serie, valores)``: the next ``h`` values of each of the ``scaled`` series."""
    last = F.slice("valores", -s.MEAN_WINDOW, s.MEAN_WINDOW)
    state = rows.select("serie", "ultimo", "centro", "desvio", last.alias("passado"),
                        F.array().cast("array<double>").alias("previsto"))
    for step in range(1, h + 1):
        lags = {f"lag_{i}": F.element_at("passado", -i) for i in range(1, s.N_LAGS + 1)}
        mean = F.aggregate("passado", F.lit(0.0), lambda a, x: a + x) / F.size("passado")
        told = state.withColumn("dia", F.date_add("ultimo", step)).withColumns(
            {**calendar("dia"), **lags, "media_movel_5": mean})
        done = model.transform(_assembler().transform(told))
        state = done.select("serie", "ultimo", "centro", "desvio",
                            F.concat(F.slice("passado", 2, s.MEAN_WINDOW - 1), F.array("prediction")).alias("passado"),
                            F.concat("previsto", F.array("prediction")).alias("previsto"))
    return state.select("serie", F.expr("transform(previsto, x -> centro + x * desvio)").alias("valores"))


def importance(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """Share of each feature; sums to 1."""
    shares = [(name, float(x)) for name, x in zip(s.FEATURES, model.featureImportances.toArray(), strict=True)]
    return rows.sparkSession.createDataFrame(shares, "feature string, importancia double").withColumn(
        "nome", label("feature", FEATURE_LABELS))


def failure() -> Column:
    return F.format_string(f"só há %d pontos e são precisos {MIN_POINTS}", F.size("valores"))
