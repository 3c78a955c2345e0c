"""DuckDB SQL with the result of each query, for checking.

The SQL states the semantics in its own way: ORs of contains() for the rules,
windows for the last feedback, plain ORDER BY and LIMIT for the extreme rows.
"""

from __future__ import annotations

from ..functions.vocab import (
    AGE_COLUMNS,
    COLUMN_SYNONYMS,
    CONFIDENCE,
    DEFAULT_VOCABULARY,
    DESCRIPTIONS,
    EXAMPLES,
    FALLBACK_COLUMNS,
    NAME_COLUMNS,
    OPERATIONS,
    POSITIVE_FEEDBACK,
    RETRAIN_ONLINE,
    ROW_WORDS,
    TRAINING_SOURCE,
    TRIGGER_WORDS,
)
from ..operators.training import SUGGESTION
from . import derived, registry


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "([" + ", ".join(map(text, values)) + "]::VARCHAR[])"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def pick(values, number: str) -> str:
    return f"{text_list(values)}[{number} % {len(values)} + 1]"


# Common table expressions ----------------------------------------------------

_phrase = pick([p for p, _ in derived.PHRASES], "event_id")
QUESTIONS = f"""questions AS (
  SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS user_id,
         {_phrase} || ' pengguna ' || user_id AS query,
         {pick([o for _, o in derived.PHRASES], "event_id")} AS expected
  FROM events)"""

_hits = " ".join(
    f"WHEN {any_of('lower(query)', words)} THEN {text(o)}" for o, words in TRIGGER_WORDS.items()
)
_sure = " ".join(f"WHEN {text(o)} THEN {c}" for o, c in CONFIDENCE.items())


def classified(source: str, name: str = "classified") -> str:
    return f"""{name} AS (
  SELECT *, coalesce(hit, 'FILTER') AS operation,
         CAST(CASE hit {_sure} ELSE 0.5 END AS DOUBLE) AS confidence,
         hit IS NOT NULL AS by_rule
  FROM (SELECT *, CASE {_hits} END AS hit FROM {source}))"""


def detected(columns: str) -> str:
    named = f"list_filter({columns}, lambda c: contains(lower(query), lower(c)))[1]"
    tries = [named]
    for term, parts in COLUMN_SYNONYMS.items():
        fits = f"list_filter({columns}, lambda c: {any_of('lower(c)', parts)})[1]"
        tries.append(f"CASE WHEN contains(lower(query), {text(term)}) THEN {fits} END")
    return f"coalesce({', '.join(tries)}, {columns}[1], 'column')"


def ident(name: str) -> str:
    return f"'`' || replace({name}, '`', '``') || '`'"


def person(names: tuple[str, ...], other: tuple[str, ...], columns: str) -> str:
    """Last column of a kind up to where both kinds have been seen."""
    mine = f"list_transform({columns}, lambda c: lower(c) IN {names})"
    theirs = f"list_transform({columns}, lambda c: lower(c) IN {other})"
    end = f"greatest(list_position({mine}, true), list_position({theirs}, true))"
    fits = f"list_filter({columns}[1:{end}], lambda c: lower(c) IN {names})"
    both = f"list_contains({mine}, true) AND list_contains({theirs}, true)"
    return f"CASE WHEN {both} THEN {fits}[-1] END"


def planned(source: str, columns: str, view: str) -> str:
    """Plan texts for rows with operation, detected_column and query."""

    def every(function: str) -> str:
        named = f"list_filter({columns}, lambda c: c <> '')"
        call = f"'{function}(' || {ident('c')} || ') AS ' || {ident('c')}"
        return (
            f"CASE WHEN len({named}) = 0 THEN '{function}(:columns)' ELSE "
            f"array_to_string(list_transform({named}, lambda c: {call}), ', ') END"
        )

    name = ident("CASE WHEN detected_column = '' THEN 'column' ELSE detected_column END")
    pair = (
        f"({ident('person_name')} || ', ' || {ident('person_age')})"
    )
    branches = []
    for operation, order in (("MAX", "DESC"), ("MIN", "ASC")):
        branches.append(
            f"WHEN operation = '{operation}' AND wants_row AND detected_column <> '' THEN "
            f"'SELECT ' || coalesce({pair}, '*') || ' FROM {view} WHERE ' || {name} || "
            f"' IS NOT NULL ORDER BY ' || {name} || ' {order} LIMIT 1'"
        )
    branches.append(
        f"WHEN operation = 'COUNT' AND wants_row_count THEN 'SELECT count(*) FROM {view}'"
    )
    calls = {"MAX": "max", "MIN": "min", "SUM": "sum", "MEAN": "avg", "COUNT": "count"}
    for operation, function in calls.items():
        branches.append(
            f"WHEN operation = '{operation}' THEN 'SELECT ' || CASE WHEN detected_column = '' "
            f"THEN {every(function)} ELSE '{function}(' || {name} || ')' END || ' FROM {view}'"
        )
    branches += [
        f"WHEN operation = 'FILTER' THEN 'SELECT * FROM {view} WHERE ' || {name} || ' > :value'",
        f"WHEN operation = 'SORT' THEN 'SELECT * FROM {view} ORDER BY ' || {name} || "
        "' ASC NULLS LAST'",
        f"WHEN operation = 'GROUP' THEN 'SELECT ' || {name} || ', :func FROM {view} WHERE ' || "
        f"{name} || ' IS NOT NULL GROUP BY ' || {name}",
    ]
    return f"""detected AS (
  SELECT *, {detected(columns)} AS detected_column,
         {any_of('lower(query)', ROW_WORDS)} AS wants_row,
         contains(lower(query), 'baris') AS wants_row_count,
         {person(NAME_COLUMNS, AGE_COLUMNS, columns)} AS person_name,
         {person(AGE_COLUMNS, NAME_COLUMNS, columns)} AS person_age
  FROM {source}), planned AS (
  SELECT *, CASE {' '.join(branches)} END AS generated_code FROM detected)"""


_lists = ", ".join(
    text_list(columns or FALLBACK_COLUMNS) for columns in derived.COLUMN_LISTS
)
WITH_COLUMNS = f"""{QUESTIONS}, listed AS (
  SELECT *, [{_lists}][id % {len(derived.COLUMN_LISTS)} + 1] AS columns FROM questions),
  {classified('listed')}"""
ITEM_COLUMNS = text_list(derived.LINEITEM_COLUMNS)
CLASSIFIED = f"{QUESTIONS}, {classified('questions')}"
SESSION = "'session_' || CAST(floor((id + 1) / 3) AS BIGINT)"
LOG = f"""{CLASSIFIED}, {planned('classified', ITEM_COLUMNS, 't')}, log AS (
  SELECT id, ts AS timestamp, query, operation AS predicted_operation, confidence,
         generated_code, to_json({ITEM_COLUMNS})::VARCHAR AS columns_used,
         {SESSION} AS session_id, user_id, strftime(ts, '%Y-%m-%d') AS log_date
  FROM planned)"""
SHORT_LOG = f"""{CLASSIFIED}, log AS (
  SELECT id, query, operation AS predicted_operation, confidence FROM classified)"""

_accepted = (
    f"coalesce(correct_operation <> '' AND lower(feedback) IN {POSITIVE_FEEDBACK}, false)"
)
FEEDBACK = f"""feedback_events AS (
  SELECT CASE WHEN event_type = 'error' THEN -1 - event_id ELSE event_id // 2 END AS query_id,
         event_id AS seq, ts, {pick(derived.FEEDBACK_WORDS, 'event_id')} AS feedback,
         {pick(derived.CORRECT_OPERATIONS, 'event_id')} AS correct_operation
  FROM events), latest AS (
  SELECT query_id, feedback AS user_feedback, correct_operation
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, seq DESC) AS place
        FROM feedback_events) WHERE place = 1)"""
_ids = " ".join(f"WHEN {text(o)} THEN {i}" for i, o in enumerate(OPERATIONS))
TRAINING = f"""{SHORT_LOG}, {FEEDBACK}, training AS (
  SELECT seq AS id, query, CASE correct_operation {_ids} ELSE -1 END AS operation_id,
         correct_operation AS operation_name, '{TRAINING_SOURCE}' AS source,
         true AS verified, ts AS created_at
  FROM feedback_events JOIN log ON log.id = query_id WHERE {_accepted})"""
READINGS = """readings AS (
  SELECT event_id, user_id,
         CASE WHEN event_id % 5 > 0 THEN event_type END AS jenis,
         CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS nilai
  FROM events)"""
PEOPLE = """people AS (
  SELECT c_custkey AS nomor, c_name AS nama, c_nationkey AS umur, c_acctbal AS saldo
  FROM customer)"""

WHOLE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
NUMBERS = (*WHOLE_NUMBERS, "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _answers() -> str:
    """Every (operation, column) answer over lineitem, one row each."""
    rows = ["SELECT 'COUNT' AS operation, '*' AS key, count(*)::DOUBLE AS number, "
            "count(*)::VARCHAR AS exact, NULL::VARCHAR AS string FROM lineitem"]
    functions = {"MAX": "max", "MIN": "min", "SUM": "sum", "MEAN": "avg", "COUNT": "count"}
    for column in derived.LINEITEM_COLUMNS:
        for operation, function in functions.items():
            numeric = column in NUMBERS
            whole = operation == "COUNT" or (column in WHOLE_NUMBERS and operation != "MEAN")
            if operation == "COUNT" or numeric:
                exact = f"{function}({column})::VARCHAR" if whole else "NULL"
                value = f"{function}({column})::DOUBLE, {exact}, NULL"
            elif operation in ("MAX", "MIN"):
                value = f"NULL, NULL, {function}({column})::VARCHAR"
            else:
                continue
            rows.append(f"SELECT '{operation}', '{column}', {value} FROM lineitem")
    return "answers AS (" + " UNION ALL ".join(rows) + ")"


def _aggregates(function: str, columns, round_to: int | None = None) -> str:
    def one(column: str) -> str:
        value = f"{function}({column})"
        return f"round({value}::DOUBLE, {round_to})" if round_to else value

    return ", ".join(f"{one(c)} AS {c}" for c in columns)


def _group_aggregates() -> str:
    parts = ["l_returnflag"]
    functions = {"max": "max", "min": "min", "sum": "sum", "mean": "avg", "count": "count"}
    for name, function in functions.items():
        for column in ("l_linenumber", "l_quantity", "l_extendedprice"):
            parts.append(f"round({function}({column})::DOUBLE, 4) AS {column}_{name}")
    return ", ".join(parts)


def _catalog() -> str:
    rows = [
        f"({i}, '{o}', {DEFAULT_VOCABULARY.priority.index(o) + 1}, {text(DESCRIPTIONS[o])}, "
        f"{text(', '.join(TRIGGER_WORDS[o]))}, {text(e)})"
        for i, o in enumerate(OPERATIONS)
        for e in EXAMPLES[o]
    ]
    names = "operation_id, operation, priority, description, keywords, example"
    return f"catalog AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v({names}))"


def _dispatch() -> str:
    values = ("max(l_extendedprice)", "min(l_discount)", "sum(l_extendedprice)",
              "avg(l_quantity)", "count(*)")
    return " UNION ALL ".join(
        f"SELECT {text(q)} AS question, round({v}::DOUBLE, 4) AS answer FROM lineitem"
        for q, v in zip(registry.DISPATCHED, values)
    )


STATS = f"""{SHORT_LOG}, {FEEDBACK}, stats AS (
  SELECT (SELECT count(*) FROM log) AS total_questions,
         (SELECT count(*) FROM log JOIN latest ON id = query_id
          WHERE user_feedback IS NOT NULL) AS questions_with_feedback,
         (SELECT round(coalesce(avg(confidence), 0), 3) FROM log) AS average_confidence,
         (SELECT count(*) FROM feedback_events JOIN log ON id = query_id
          WHERE {_accepted}) AS verified_samples)"""
JUDGED = f"""{CLASSIFIED}, judged AS (
  SELECT *, CASE WHEN operation = expected THEN 'correct' ELSE 'incorrect' END AS feedback,
         {SESSION} AS session_id
  FROM classified)"""


def _accuracy(by: str) -> str:
    return f"""WITH {JUDGED} SELECT {by}, count(*) AS questions,
      count(*) FILTER (WHERE feedback = 'correct') AS correct,
      round(count(*) FILTER (WHERE feedback = 'correct') / count(*), 4) AS accuracy,
      round(avg(confidence), 4) AS mean_confidence FROM judged GROUP BY {by}"""


_log_query = f"""WITH {LOG} SELECT id, query, predicted_operation, confidence, generated_code,
      columns_used, session_id, user_id, log_date FROM log"""
_latest = f"WITH {FEEDBACK} SELECT query_id, user_feedback, correct_operation FROM latest"

ORACLES = {
    "intent_catalog": f"""WITH {CLASSIFIED}, {_catalog()},
      used AS (SELECT operation, count(*) AS questions FROM classified GROUP BY operation)
      SELECT operation, operation_id, priority, description, keywords, example,
             coalesce(questions, 0) AS questions
      FROM catalog LEFT JOIN used USING (operation)""",
    "classify_intent": f"""WITH {CLASSIFIED}
      SELECT id, query, operation, confidence, by_rule FROM classified""",
    "classify_default_share": f"""WITH texts AS (
        SELECT 'conversations' AS source, text AS query FROM conversations
        UNION ALL SELECT 'documents', text FROM documents), {classified('texts')}
      SELECT source, operation, count(*) AS texts,
             count(*) FILTER (WHERE NOT by_rule) AS by_default
      FROM classified GROUP BY source, operation""",
    "detect_column": f"""WITH {WITH_COLUMNS}
      SELECT id, query, {detected('columns')} AS detected_column FROM classified""",
    "plan_text": f"""WITH {WITH_COLUMNS}, {planned('classified', 'columns', 't')}
      SELECT id, generated_code FROM planned""",
    "classify_full": f"""WITH {CLASSIFIED}, {planned('classified', ITEM_COLUMNS, 'lineitem')}
      SELECT id, query, operation, confidence, detected_column, wants_row,
             wants_row_count, generated_code FROM planned""",
    "classify_with_model": f"""WITH {CLASSIFIED}, modelled AS (
        SELECT * REPLACE (CASE WHEN by_rule THEN operation ELSE expected END AS operation)
        FROM classified), {planned('modelled', ITEM_COLUMNS, 'lineitem')}
      SELECT id, by_rule, operation, generated_code,
             CASE WHEN NOT by_rule THEN 'first' END AS model_version, true AS confident
      FROM planned""",
    "run_plan_text": f"""WITH {CLASSIFIED}, {_answers()}, asked AS (
        SELECT *, {detected(ITEM_COLUMNS)} AS detected_column FROM classified)
      SELECT id, asked.operation, detected_column,
             round(number, 4) AS answer_double, string AS answer_string
      FROM asked LEFT JOIN answers ON answers.operation = asked.operation
       AND key = CASE WHEN asked.operation = 'COUNT' AND contains(lower(query), 'baris')
                      THEN '*' ELSE detected_column END
       AND NOT (asked.operation IN ('MAX', 'MIN') AND {any_of('lower(query)', ROW_WORDS)})""",
    "ask_max": "SELECT max(p_retailprice) AS p_retailprice FROM part",
    "ask_max_all": "SELECT "
    + _aggregates("max", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                          "o_orderdate", "o_orderpriority"))
    + " FROM orders",
    "ask_min": "SELECT min(o_orderdate) AS o_orderdate FROM orders",
    "ask_min_all": f"WITH {READINGS} SELECT "
    + _aggregates("min", ("event_id", "user_id", "jenis", "nilai")) + " FROM readings",
    "ask_sum": "SELECT round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem",
    "ask_sum_all": f"SELECT {_aggregates('sum', NUMBERS, 4)} FROM lineitem",
    "ask_mean": f"WITH {READINGS} SELECT round(avg(nilai), 4) AS nilai FROM readings",
    "ask_mean_all": f"SELECT {_aggregates('avg', NUMBERS, 4)} FROM lineitem",
    "ask_count": f"WITH {READINGS} SELECT count(nilai) AS nilai FROM readings",
    "ask_count_all": f"WITH {READINGS} SELECT "
    + _aggregates("count", ("event_id", "user_id", "jenis", "nilai")) + " FROM readings",
    "ask_row_count": "SELECT count(*) AS row_count FROM lineitem",
    "ask_argmax": "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1",
    "ask_argmin": "SELECT * FROM lineitem ORDER BY l_quantity, "
    + ", ".join(c for c in derived.LINEITEM_COLUMNS if c != "l_quantity") + " LIMIT 1",
    "ask_argmax_named": f"WITH {PEOPLE} SELECT nama, umur FROM people "
    "ORDER BY umur DESC, nomor LIMIT 1",
    "ask_argmin_named": f"WITH {PEOPLE} SELECT nama, umur FROM people "
    "ORDER BY saldo, nomor LIMIT 1",
    "ask_filter_gt": "SELECT * FROM orders WHERE o_totalprice > 200000",
    "ask_sort": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey",
    "ask_group_agg": f"SELECT {_group_aggregates()} FROM lineitem GROUP BY l_returnflag",
    "group_fold": """SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS geometric_mean
      FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""",
    "ask_group_size": f"WITH {READINGS} SELECT jenis, count(*) AS size FROM readings "
    "WHERE jenis IS NOT NULL GROUP BY jenis",
    "ask_sort_project": "SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice",
    "ask_dispatch": _dispatch(),
    "answer_many": f"""WITH {CLASSIFIED}, {_answers()}, asked AS (
        SELECT id, query, operation, {detected(ITEM_COLUMNS)} AS detected_column FROM classified)
      SELECT id, query, asked.operation, detected_column,
             round(number, 4) AS answer_double, exact AS answer_exact, string AS answer_string,
             CASE WHEN asked.operation = 'FILTER' THEN 'needs_value'
                  WHEN asked.operation = 'GROUP' THEN 'needs_func'
                  WHEN asked.operation = 'SORT' THEN 'whole_table'
                  WHEN key IS NULL THEN 'unsupported_type'
                  WHEN {any_of('lower(query)', ROW_WORDS)} AND asked.operation IN ('MAX', 'MIN')
                  THEN 'row_wanted' ELSE 'ok' END AS status
      FROM asked LEFT JOIN answers ON answers.operation = asked.operation
       AND key = CASE WHEN asked.operation = 'COUNT' AND contains(lower(query), 'baris')
                      THEN '*' ELSE detected_column END""",
    "log_append": _log_query,
    "stream_classify": _log_query,
    "feedback_latest": _latest,
    "stream_feedback": _latest,
    "stream_latest_feedback": _latest,
    "log_compact": _log_query,
    "log_with_feedback": f"""WITH {SHORT_LOG}, {FEEDBACK}
      SELECT id, query, predicted_operation, user_feedback, correct_operation
      FROM log LEFT JOIN latest ON id = query_id""",
    "feedback_accepted": f"""WITH {FEEDBACK} SELECT query_id, seq, feedback, correct_operation
      FROM feedback_events WHERE {_accepted}""",
    "training_set": f"""WITH {TRAINING} SELECT id, query, operation_id, operation_name, source,
      verified, created_at FROM training""",
    "training_read": f"WITH {TRAINING} SELECT query, operation_id FROM training",
    "training_export": f"""WITH {TRAINING} SELECT query, operation_id,
      CASE WHEN operation_id >= 0 THEN operation_name END AS operation_name FROM training""",
    "export_summary": f"""WITH {TRAINING} SELECT 'exported' AS status,
      count(*) AS samples_exported FROM training""",
    "retrain_gate": f"""WITH {STATS}
      SELECT verified_samples, min_samples, verified_samples >= min_samples AS should_retrain,
             greatest(min_samples - verified_samples, 0) AS samples_needed
      FROM stats, (VALUES (5), (10), (20), (50), (1000000000)) AS v(min_samples)""",
    "training_append": f"""WITH {TRAINING} SELECT id, query, operation_id, operation_name, source,
      verified, created_at FROM training""",
    "log_row_ids": """SELECT count(*) AS questions, count(*) AS ids, 1 AS least,
      count(*) AS greatest FROM conversations""",
    "retrain_insufficient": f"""WITH {STATS} SELECT 'insufficient' AS status,
      1000000000 AS min_samples, verified_samples AS training_samples,
      0 AS samples_exported, CASE WHEN verified_samples >= {RETRAIN_ONLINE}
      THEN {text(SUGGESTION)} END AS suggestion FROM stats""",
    "retrain_versions": f"""WITH {QUESTIONS}, folds AS (
        SELECT expected, CAST('0x' || substr(md5(query), 1, 8) AS BIGINT) % 5 = 0 AS held
        FROM questions), counts AS (
        SELECT count(*) FILTER (WHERE held) AS held_out,
               count(*) FILTER (WHERE NOT held) AS taught,
               count(*) FILTER (WHERE NOT held AND expected = 'MAX') AS taught_max FROM folds)
      SELECT version, status, CASE version WHEN 2 THEN taught_max ELSE taught END AS training_rows,
             held_out, version <> 2 AS all_right, serving
      FROM counts, (VALUES (1, 'first', 1), (2, 'refused', 1), (3, 'accepted', 3))
        AS v(version, status, serving)""",
    "retrain_status": f"""WITH {STATS}
      SELECT CASE WHEN verified_samples >= 10 THEN 'completed' ELSE 'insufficient' END AS status,
             10 AS min_samples, verified_samples AS training_samples,
             CASE WHEN verified_samples >= 10 THEN verified_samples ELSE 0 END AS samples_exported,
             CASE WHEN verified_samples >= {RETRAIN_ONLINE} THEN {text(SUGGESTION)} END
             AS suggestion FROM stats""",
    "feedback_reply": f"""WITH {STATS} SELECT query_id, feedback,
      CASE WHEN verified_samples >= {RETRAIN_ONLINE} THEN {text(SUGGESTION)} END AS suggestion
      FROM feedback_events, stats""",
    "log_stats": f"""WITH {STATS}
      SELECT *, verified_samples >= {RETRAIN_ONLINE} AS model_needs_retraining FROM stats""",
    "log_stats_display": f"""WITH {STATS} SELECT total_questions, questions_with_feedback,
      round(average_confidence * 100, 1) AS confidence_percent, verified_samples FROM stats""",
    "log_by_operation": f"""WITH {SHORT_LOG} SELECT predicted_operation, count(*) AS questions
      FROM log GROUP BY predicted_operation""",
    "eval_feedback": f"WITH {JUDGED} SELECT id, expected, operation, feedback FROM judged",
    "eval_accuracy": _accuracy("expected"),
    "eval_by_session": _accuracy("session_id"),
    "eval_replay": f"""WITH {JUDGED}, counted AS (
        SELECT grouping_id(expected, operation, session_id) AS level, expected, operation,
               session_id, count(*) AS questions,
               count(*) FILTER (WHERE feedback = 'correct') AS correct, avg(confidence) AS mean
        FROM judged
        GROUP BY GROUPING SETS ((expected, operation), (expected), (session_id), ()))
      SELECT CASE level WHEN 1 THEN 'confusion' WHEN 3 THEN 'class' WHEN 6 THEN 'session'
             ELSE 'all' END AS level, expected, operation AS predicted_operation, session_id,
             questions, correct, round(correct / questions, 4) AS accuracy,
             round(mean, 4) AS mean_confidence FROM counted""",
    "stream_stats": f"""WITH {CLASSIFIED} SELECT operation, count(*) AS questions,
      round(avg(confidence), 4) AS mean_confidence FROM classified GROUP BY operation""",
    "vector_topk": f"""WITH parts AS (
        SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
        FROM embeddings), means AS (
        SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos), centers AS (
        SELECT label, list(x ORDER BY pos) AS center FROM means GROUP BY label), scored AS (
        SELECT c.label, vec_id,
               round(list_cosine_similarity(center, embedding::DOUBLE[]), 6) AS similarity
        FROM centers c CROSS JOIN embeddings), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INTEGER AS rank
        FROM scored)
      SELECT label, vec_id, similarity, rank FROM ranked WHERE rank <= {registry.TOP_K}""",
    "vector_topk_index": f"""SELECT count(*) AS queries, count(*) * {registry.TOP_K} AS pairs,
      true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""",
    "vector_topk_blocks": f"""WITH scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)
               AS similarity
        FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 50 = 0), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER
               AS rank
        FROM scored)
      SELECT query_id, vec_id, similarity, rank FROM ranked WHERE rank <= {registry.TOP_K}""",
}
