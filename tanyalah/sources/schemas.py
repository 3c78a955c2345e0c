"""Layout of the append-only tables, as DDL strings."""

# One row per classified question; ``log_date`` is the partition column.
QUERY_LOG = (
    "id bigint, timestamp timestamp_ntz, query string, predicted_operation string, "
    "confidence double, generated_code string, columns_used array<string>, "
    "session_id string, user_id string, model_version string, log_date date"
)

# One row per feedback event. (ts, seq) orders the events of one question.
FEEDBACK_EVENTS = (
    "query_id bigint, seq bigint, ts timestamp_ntz, feedback string, "
    "correct_operation string, comments string"
)

TRAINING_DATA = (
    "id bigint, query string, operation_id int, operation_name string, "
    "source string, verified boolean, created_at timestamp_ntz"
)

LABELLED_CORPUS = "query string, operation_id int, operation_name string"

TRAINING_EXPORT = "query string, operation_id int, operation_name string"


def field_names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
