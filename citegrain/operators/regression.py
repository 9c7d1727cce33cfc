"""Feature pipeline, elastic-net regression and vector statistics on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.operators.durable import durable

# The settings of the tag-count model.
SETTINGS = {"maxIter": 10, "regParam": 0.3, "elasticNetParam": 0.8, "standardization": False}
TRAIN_PERCENT = 80
SEED = 23


def cross_section(df: DataFrame, year: int, columns: Sequence[str]) -> DataFrame:
    """Distinct complete rows of one year.  The year is filtered first so the scan can skip files."""
    return df.where(F.col("insp_year") == year).distinct().dropna("any").select(*columns)


def split(
    df: DataFrame, key: Sequence[str], percent: int = TRAIN_PERCENT, seed: int = SEED, side: Column | None = None
):
    """Train and test rows by a hash of the key, or by a number from 0 to 99: the same rows whatever the partitioning."""
    side = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(100)) if side is None else side
    return df.where(side < percent), df.where(side >= percent)


def feature_stages(numeric: Sequence[str], indexed: Sequence[str], one_hot: str | None) -> list:
    coded = [*indexed, *([one_hot] if one_hot else [])]
    inputs, stages = [*numeric, *[f"{c}_index" for c in indexed]], []
    if coded:
        stages.append(StringIndexer(inputCols=coded, outputCols=[f"{c}_index" for c in coded]))
    if one_hot:
        stages.append(OneHotEncoder(inputCols=[f"{one_hot}_index"], outputCols=[f"{one_hot}_vec"]))
        inputs.append(f"{one_hot}_vec")
    return [
        *stages,
        VectorAssembler(inputCols=inputs, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="features_scaled"),
    ]


def encoded_features(df: DataFrame, numeric: Sequence[str], indexed: Sequence[str], one_hot: str) -> DataFrame:
    """Rows with their codes, the position of their level in the one-hot vector (null for the last level) and the
    scaled features as an array."""
    made = Pipeline(stages=feature_stages(numeric, indexed, one_hot)).fit(df).transform(df)
    position = F.array_position(vector_to_array(f"{one_hot}_vec"), F.lit(1.0)) - 1
    return made.withColumn("level", F.when(position >= 0, position)).withColumn("scaled", vector_to_array("features_scaled"))


@dataclass
class TagModel:
    features: PipelineModel
    line: object
    label: str
    names: list[str]
    train: DataFrame
    test: DataFrame

    def predictions(self) -> DataFrame:
        return self.line.transform(self.test)

    def coefficients(self) -> DataFrame:
        """Intercept and coefficients by feature name; as many rows as features."""
        values = [float(self.line.intercept), *map(float, self.line.coefficients.toArray())]
        rows = [(i, n, v) for i, (n, v) in enumerate(zip(["intercept", *self.names], values))]
        return self.train.sparkSession.createDataFrame(rows, "position int, feature string, coefficient double")

    def metrics(self) -> DataFrame:
        summary = self.line.summary
        evaluator = RegressionEvaluator(
            predictionCol=self.line.getPredictionCol(), labelCol=self.label, metricName="rmse"
        )
        rows = [
            ("train_rmse", float(summary.rootMeanSquaredError)),
            ("train_mae", float(summary.meanAbsoluteError)),
            ("train_r2", float(summary.r2)),
            ("test_rmse", float(evaluator.evaluate(self.predictions()))),
        ]
        return self.train.sparkSession.createDataFrame(rows, "metric string, value double")


def fit_tag_model(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    indexed: Sequence[str],
    one_hot: str | None,
    key: Sequence[str],
    side: Column | None = None,
    tolerance: float = 1e-6,
) -> TagModel:
    """Index, encode, assemble and scale on all rows, then fit on the training side.

    Every fit and metric reads the rows once more, so they are kept first.  The solver stops at the settings'
    number of steps or where a step gains less than `tolerance`, relative to the loss.
    """
    complete = durable(df.dropna("any"))
    stages = feature_stages(numeric, indexed, one_hot)
    features = Pipeline(stages=stages).fit(complete)
    scaled = features.transform(complete)
    train, test = split(scaled, key, side=side)
    line = LinearRegression(
        featuresCol="features_scaled", labelCol=label, predictionCol=f"pr_{label}", tol=tolerance, **SETTINGS
    ).fit(train)
    levels = level_names(scaled, f"{one_hot}_vec") if one_hot else []
    names = [*numeric, *[f"{c}_index" for c in indexed], *levels]
    return TagModel(features, line, label, names, train, test)


def level_names(df: DataFrame, column: str) -> list[str]:
    """Level names of a one-hot column, from its metadata."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]["binary"]
    return [a["name"] for a in sorted(attributes, key=lambda a: a["idx"])]


def as_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df.dropna(subset=list(columns)))


def vector_correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation matrix as one row per column pair; the matrix has features-squared entries."""
    matrix = Correlation.corr(as_vector(df, columns).select("features"), "features", method).first()[0].toArray()
    rows = [
        (a, b, float(matrix[i][j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    ]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def vector_summary(vectors: DataFrame, features: str = "features", weight: Column | None = None) -> DataFrame:
    """Mean of every vector position and the row count, weighted on request."""
    metrics = Summarizer.metrics("mean", "count")
    both = metrics.summary(F.col(features), weight) if weight is not None else metrics.summary(F.col(features))
    return vectors.select(both.alias("s")).select(
        F.posexplode(vector_to_array("s.mean")).alias("position", "mean"), F.col("s.count").alias("count")
    )
