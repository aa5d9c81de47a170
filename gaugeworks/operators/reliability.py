"""A reliability head: logistic regression on a row's own confidence features, to rank answers anew."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import probability as P

FEATURES = ("pmax", "margin", "entropy", "log_k")


def features(rows: DataFrame) -> DataFrame:
    """rows with pmax, margin, normalised entropy and log of the number of options."""
    k = F.size("p")
    return rows.withColumn("pmax", F.array_max("p")).withColumn("margin", P.margin(F.col("p"))).withColumn("entropy", F.when(k > 1, P.entropy(F.col("p")) / F.ln(k.cast("double"))).otherwise(0.0)).withColumn("log_k", F.ln(k.cast("double")))


def fit(rows: DataFrame, ridge: float = 1.0) -> LogisticRegressionModel:
    """L2 logistic regression of ok on standardised features, distributed; the intercept is free."""
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(rows)).withColumn("y", F.col("ok").cast("double"))
    return LogisticRegression(featuresCol="x", labelCol="y", regParam=ridge / max(1, rows.count()), elasticNetParam=0.0, standardization=True).fit(x)


def reranked(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """rows with conf from the model."""
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(rows))
    out = model.transform(x)
    return out.withColumn("conf", F.get(vector_to_array("probability"), F.lit(1))).drop("x", "rawPrediction", "probability", "prediction")
