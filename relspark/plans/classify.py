"""Train, evaluate and apply a classifier of objects."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import vectors as V
from relspark.plans import perceptron
from relspark.sources.stored import stored


def classifier_input(features: Column, pe_width: int, steps: int | None = None) -> Column:
    """PE features, then how often each opcode occurs, in the whole sequence or its first `steps` codes."""
    count = F.greatest(F.size(features) - pe_width, F.lit(0)) if steps is None else F.lit(steps)
    opcodes = F.slice(features, pe_width + 1, count)
    return F.concat(F.slice(features, 1, pe_width), V.code_counts(opcodes))


def _sparse(data: DataFrame) -> bool:
    """Whether the features of a table are vectors, which may be sparse, and not arrays."""
    return isinstance(data.schema["features"].dataType, VectorUDT)


def _vector(data: DataFrame) -> Column:
    """The features of a table, arrays or vectors, as vectors."""
    return (F.col("features") if _sparse(data) else array_to_vector("features")).alias("vector")


def train(
    data: DataFrame,
    width: int,
    classes: int,
    hidden: tuple[int, ...] = (64,),
    max_iter: int = 100,
    seed: int = 1,
) -> PipelineModel:
    """Fit scaler and perceptron on (label one-hot, features of `width` numbers, as arrays or vectors).

    Spark's perceptron makes dense rows of vectors too, and keeps them; so those are fitted by `perceptron.fitted`.
    """
    rows = stored(
        data.select(
            V.arg_max(F.col("label")).cast("double").alias("class"),
            _vector(data),
        )
    )
    scaler = MinMaxScaler(inputCol="vector", outputCol="scaled")
    net = MultilayerPerceptronClassifier(
        layers=[width, *hidden, classes],
        featuresCol="scaled",
        labelCol="class",
        maxIter=max_iter,
        seed=seed,
    )
    if not _sparse(data):
        return Pipeline(stages=[scaler, net]).fit(rows)
    ranges = scaler.fit(rows)
    low, high = ranges.originalMin.toArray(), ranges.originalMax.toArray()
    weights = perceptron.fitted(rows, low, high, net.getLayers(), max_iter, seed)
    net = net.setMaxIter(0).setInitialWeights(Vectors.dense(weights))
    row = rows.sparkSession.createDataFrame([(0.0, Vectors.sparse(width, []))], ["class", "scaled"])
    return PipelineModel([ranges, net.fit(row)])  # no step is made, so the weights stay


def _predictions(model: PipelineModel, data: DataFrame, *columns: Column | str) -> DataFrame:
    """(columns, prediction)."""
    rows = data.select(*columns, _vector(data))
    if not _sparse(data):
        rows = model.transform(rows)
        number = F.col("prediction").cast("int")
    else:
        ranges, net = model.stages
        low, high = ranges.originalMin.toArray(), ranges.originalMax.toArray()
        context = data.sparkSession.sparkContext
        number = perceptron.predicted(F.col("vector"), net.weights.toArray(), low, high, net.getLayers(), context)
    return rows.withColumn("prediction", number).select(*rows.columns[: len(columns)], "prediction")


def predict(model: PipelineModel, data: DataFrame) -> DataFrame:
    """(object_id, prediction)."""
    return _predictions(model, data, "object_id")


def evaluate(model: PipelineModel, data: DataFrame) -> DataFrame:
    """(object_id, label, prediction) of labelled data."""
    return _predictions(model, data, "object_id", V.arg_max(F.col("label")).cast("int").alias("label"))


def accuracy(evaluated: DataFrame) -> DataFrame:
    """One row: the share of correct predictions."""
    hit = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
    return evaluated.agg(F.avg(hit).alias("accuracy"))


def evaluation_line() -> Column:
    return F.format_string("Label: %d, Prediction: %d", "label", "prediction")


def prediction_line() -> Column:
    return F.format_string("Sha256: %s, Prediction: %d", "object_id", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
