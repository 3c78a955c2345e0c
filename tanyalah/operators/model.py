"""Learned classifier for the questions that no rule covers."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import DEFAULT_VOCABULARY, OPERATIONS, Vocabulary
from ..sources.corpus import seed_corpus
from .classify import classify_operation
from .learned import TEXT, VERSION, Model

DEFAULT_EPOCHS = 10
FEATURES = 1 << 13


def fit_model(
    labelled: DataFrame, epochs: int = DEFAULT_EPOCHS, features: int = FEATURES
) -> PipelineModel:
    """Fit on (query, operation_id) rows and the built-in seed.

    Words are hashed to ``features`` numbers; take more than there are
    different words, else some share one. Equal questions with equal labels are first merged into one weighted row,
    which gives the same model from far fewer rows. Rows with an unknown
    operation have no label to learn.
    """
    columns = ["query", "operation_id"]
    examples = labelled.select(*columns).unionByName(
        seed_corpus(labelled.sparkSession).select(*columns)
    )
    weighted = (
        examples.filter(F.col("operation_id").between(0, len(OPERATIONS) - 1))
        .groupBy(F.col("query").alias(TEXT), F.col("operation_id").cast("double").alias("label"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .persist()  # fitting reads it more than once
    )
    steps = [
        RegexTokenizer(
            inputCol=TEXT, outputCol="__words", gaps=False, pattern=r"[\p{L}\p{N}]+"
        ),
        HashingTF(inputCol="__words", outputCol="__features", numFeatures=features),
        LogisticRegression(
            featuresCol="__features", labelCol="label", weightCol="weight",
            probabilityCol="__probability", rawPredictionCol="__raw",
            predictionCol="__prediction", maxIter=epochs, regParam=0.001,
        ),
    ]
    try:
        return Pipeline(stages=steps).fit(weighted)
    finally:
        weighted.unpersist()


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify_with_model(
    questions: DataFrame,
    model: Model,
    text: str = "query",
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """``classify_operation`` with a model, without its version."""
    return classify_operation(questions, text, vocabulary, model).drop(VERSION)
