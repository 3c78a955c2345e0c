"""Questions in, DataFrame answers out, on Spark."""

from .functions.vocab import Vocabulary
from .operators.answer import ask, understand
from .operators.answer_many import answer_many
from .operators.classify import classify, classify_column, classify_operation, intent_catalog
from .operators.feedback import feedback_accepted, feedback_latest, log_with_feedback
from .operators.fold import Fold, fold_groups
from .operators.learned import Served
from .operators.model import classify_with_model, fit_model, load_model
from .operators.similarity import top_k_similar
from .operators.stats import by_operation, display_stats, log_stats
from .operators.training import export_training, read_training, retrain, retrain_gate, training_set
from .operators.typed_plan import run_plan, run_plans, with_typed_plan
from .operators.vector_index import build_index, top_k_indexed
from .operators.versions import retrain_version, serving_model
from .sources.query_log import append_feedback, append_log, log_rows, read_feedback, read_log

__all__ = [
    "Fold", "Served", "Vocabulary", "build_index", "fold_groups", "retrain_version", "run_plan", "run_plans",
    "serving_model", "top_k_indexed", "with_typed_plan", "answer_many", "append_feedback", "append_log", "ask", "by_operation",
    "classify", "classify_column", "classify_operation", "classify_with_model",
    "display_stats", "export_training", "feedback_accepted", "feedback_latest", "fit_model",
    "intent_catalog", "load_model", "log_rows", "log_stats", "log_with_feedback",
    "read_feedback", "read_log", "read_training", "retrain", "retrain_gate", "top_k_similar",
    "training_set", "understand",
]
