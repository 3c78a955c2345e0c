"""A learned model's decision on the questions that no rule covers, in tables, streams and single questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intent import operation_name

TEXT = "__model_text"
VERSION = "model_version"


@dataclass(frozen=True)
class Served:
    """A fitted model under the name by which the log remembers it."""

    pipeline: PipelineModel
    version: str


Model = PipelineModel | Served


def decide(ruled: DataFrame, model: Model, text: str) -> DataFrame:
    """Replace operation and confidence where no rule applied, and add model_version.

    The model gets an empty text where a rule applied, which costs it next to
    nothing. So one pass over the questions is enough: no cache, and no second
    scan to split off the rest; a stream stays without state.
    """
    served = model if isinstance(model, Served) else Served(model, model.uid)
    asked = F.when(~F.col("by_rule"), F.col(text)).otherwise("")
    scored = served.pipeline.transform(ruled.withColumn(TEXT, F.coalesce(asked, F.lit(""))))
    chosen = {
        "operation": F.when(F.col("by_rule"), F.col("operation")).otherwise(
            operation_name(F.col("__prediction"))
        ),
        "confidence": F.when(F.col("by_rule"), F.col("confidence")).otherwise(
            F.array_max(vector_to_array("__probability"))
        ),
        VERSION: F.when(~F.col("by_rule"), F.lit(served.version)),
    }
    return scored.withColumns(chosen).select(*ruled.columns, VERSION)
