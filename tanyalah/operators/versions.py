"""Model versions: a retraining serves only if it is no worse than what serves now.

Every retraining leaves a model in a folder of its own and then one row in the
table of decisions. The last row names the serving version, so a retraining
that fails half-way changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import values
from ..functions.vocab import RETRAIN_MANUAL
from ..sources.query_log import read_table
from ..sources.scratch import unique
from .classify import classify_operation
from .learned import Served, decide
from .model import DEFAULT_EPOCHS, FEATURES, fit_model, load_model

FOLDS = 5
DECISIONS = (
    "version bigint, status string, training_rows bigint, held_out bigint, hits bigint, "
    "champion bigint, champion_hits bigint, serving bigint, model_path string"
)


def held_out(text: str = "query", folds: int = FOLDS) -> Column:
    """Whether a question belongs to the fold that no model is fitted on.

    It goes by the question alone, so equal questions are on one side, in this
    retraining and in all others.
    """
    first = F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 8), 16, 10)
    return first.cast("bigint") % folds == 0


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per retraining."""
    return read_table(spark, f"{folder}/decisions", DECISIONS)


def serving_model(spark: SparkSession, folder: str) -> Served | None:
    """The model that serves, or None before the first one."""
    table = decisions(spark, folder)
    last = table.agg(F.max_by("serving", "version")).first()[0]
    if last is None:
        return None
    path = table.where(F.col("version") == last).first()["model_path"]
    return Served(load_model(path), str(last))


def hits(model: Served, judged: DataFrame) -> int:
    """Questions to which the model gives their label; rules have no part."""
    unruled = judged.select("query", "operation_name").withColumns(
        {"by_rule": F.lit(False), "operation": F.lit(None).cast("string"), "confidence": F.lit(0.0)}
    )
    told = decide(unruled, model, "query")
    return told.where("operation = operation_name").count()


def retrain_version(
    training: DataFrame,
    folder: str,
    held: DataFrame | None = None,
    epochs: int = DEFAULT_EPOCHS,
    needed: int = RETRAIN_MANUAL,
    features: int = FEATURES,
) -> DataFrame:
    """Fit a challenger and let it serve if it has at least the champion's hits; gives its row of the decisions.

    ``training`` has query, operation_id and operation_name. The challenger is
    fitted outside the held-out fold, as the champion was; both are compared
    on the fold, of ``held`` if given, else of ``training``. Labels that name
    no operation are in neither. status: insufficient (nothing is fitted), first, accepted or refused.
    """
    spark = training.sparkSession
    known = training.select("query", "operation_id", "operation_name").where("operation_id >= 0")
    fitted_on = known.where(~held_out())
    judge = (known if held is None else held.select("query", "operation_id", "operation_name").where("operation_id >= 0")).where(held_out())
    rows, asked = fitted_on.count(), judge.count()
    version = decisions(spark, folder).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    champion = serving_model(spark, folder)
    serving = int(champion.version) if champion else None
    own = best = path = None
    status = "insufficient"
    if rows >= needed:
        path = f"{folder}/models/{version}-{unique()}"
        pipeline = fit_model(fitted_on, epochs, features)
        pipeline.write().save(path)
        own = hits(Served(pipeline, str(version)), judge)
        best = hits(champion, judge) if champion else None
        status = "first" if best is None else "accepted" if own >= best else "refused"
        serving = version if status != "refused" else serving
    row = (version, status, rows, asked, own, int(champion.version) if champion else None, best, serving, path)
    entry = spark.sql(values([row], DECISIONS))
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/decisions")
    return entry
