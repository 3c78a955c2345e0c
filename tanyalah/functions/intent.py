"""SQL expressions that turn a question into an operation.

``lowered`` is the SQL text of the lower-cased question: a column of its own, so
that Spark lower-cases every question once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import array, string
from .vocab import (
    CONFIDENCE,
    DEFAULT_CONFIDENCE,
    DEFAULT_OPERATION,
    DEFAULT_VOCABULARY,
    OPERATIONS,
    ROW_COUNT_WORD,
    ROW_WORDS,
    Vocabulary,
    shortest_words,
)


# Up to this many words an OR of contains() is fastest. With many more, the
# generated method gets too long for the JVM to compile.
WORDS_IN_CODE = 80


def contains_any(lowered: str, words: Sequence[str], unrolled: bool = True) -> str:
    """True where one of the words occurs (regular expressions take far longer)."""
    if not unrolled:
        return f"exists({array(words)}, word -> contains({lowered}, word))"
    return "(" + " OR ".join(f"contains({lowered}, {string(w)})" for w in words) + ")"


def rule_number(lowered: str, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> str:
    """1-based position of the first operation whose words occur, 0 if none."""
    needed = [shortest_words(tuple(w)) for w in vocabulary.trigger_words.values()]
    unrolled = sum(map(len, needed)) <= WORDS_IN_CODE
    branches = [
        f"WHEN {contains_any(lowered, words, unrolled)} THEN {number}"
        for number, words in enumerate(needed, start=1)
    ]
    return f"CASE {' '.join(branches)} ELSE 0 END"


def operation_of(rule: str, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> str:
    # The coalesce tells Spark that there is always an operation.
    names = array((DEFAULT_OPERATION, *vocabulary.priority))
    return f"coalesce(get({names}, {rule}), {string(DEFAULT_OPERATION)})"


def confidence_of(rule: str, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> str:
    values = (DEFAULT_CONFIDENCE, *(CONFIDENCE[o] for o in vocabulary.priority))
    return f"get({array(values)}, {rule})"


def wants_row(lowered: str) -> str:
    """The question asks who or which one, so it wants a row, not a value."""
    return f"coalesce({contains_any(lowered, ROW_WORDS)}, false)"


def wants_row_count(lowered: str) -> str:
    return f"coalesce(contains({lowered}, {string(ROW_COUNT_WORD)}), false)"


def operation_id(name: Column) -> Column:
    """Id of an operation name, -1 if it is unknown. Needs no join."""
    known = F.expr(array(OPERATIONS))
    return (F.array_position(known, name) - 1).cast("int")


def operation_name(number: Column) -> Column:
    """Name of an operation id, null if it is unknown. Needs no join."""
    return F.get(F.expr(array(OPERATIONS)), number.cast("int"))
