"""Quality rules: a learned decision list over text statistics, emitted as one Spark conditional expression.

Sequential covering: while rejected texts are left, a rule grows on two thirds
of the labelled rows, one threshold condition at a time by FOIL gain, until it
covers no good text; it is then pruned from its end on the other third. Rules
that fail there end the list. A rule is a conjunction of thresholds on named
statistics, so the list can be read, stored and edited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.words import SHINGLE, SPACE, blocks, mix, per_text, shingles_of, span_hashes, spans, words_of

LABELLED_ROWS = 20_000
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
LEAST_PRECISION = 0.9
LEAST_COVERED = 5
MOST_RULES, MOST_CONDITIONS = 32, 4
THRESHOLDS = 48
CLOSE_GAIN = 0.99

_FLAGS = {
    "n_symbols": b"#*$%&|<>",
    "n_pipes": b"|",
    "n_marks": b"!?",
    "n_upper": bytes(range(65, 91)),
    "n_digits": b"0123456789",
    "n_stops": b".,;:",
}
_TABLES = {name: np.isin(np.arange(256), list(chars)) for name, chars in _FLAGS.items()}
_START = (np.arange(256) & 0xC0) != 0x80
COUNTS = ["n_words", "word_chars", *_FLAGS, "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_stutters"]
# Ratios that rules may use: numerator, denominator.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "stops_per_word": ("n_stops", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "stutter_share": ("n_stutters", "n_words"),
}
FEATURES = [*RATIOS, "n_words"]


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


def _counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words = words_of(buf, offsets)
    out = {"n_words": np.bincount(words.doc, minlength=n), "word_chars": per_text(_START[buf] & ~SPACE[buf], offsets)}
    for name, table in _TABLES.items():
        out[name] = per_text(table[buf], offsets)

    # A line's last byte is its break, or the text's end; lines are spans between breaks.
    start, end, doc = spans(buf, offsets, buf != 10)
    held = np.concatenate([[0], np.cumsum(~SPACE[buf])])
    real = held[end] > held[start]
    keys = mix(span_hashes(buf, start[real], end[real]) ^ mix(doc[real].astype(np.uint64)))
    out["n_lines"] = per_text(buf == 10, offsets) + 1
    first = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(doc[real], minlength=n) - np.bincount(doc[real][first], minlength=n)

    hashes, at = shingles_of(words)
    mark = words.doc.astype(np.uint64)
    _, group, size = np.unique(mix(hashes ^ mix(mark[at])), return_inverse=True, return_counts=True)
    again = at[size[group] > 1]
    cover = np.bincount(again, minlength=len(words.doc) + SHINGLE).astype(np.int64) - np.bincount(again + SHINGLE, minlength=len(words.doc) + SHINGLE)[: len(words.doc) + SHINGLE]
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(cover)[: len(words.doc)] > 0], minlength=n)
    once = np.unique(mix(words.hash ^ mix(mark)), return_index=True)[1]
    out["n_distinct_words"] = np.bincount(words.doc[once], minlength=n)
    stutter = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["n_stutters"] = np.bincount(words.doc[1:][stutter], minlength=n)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(1)):
            counts = _counts(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], names=["row", *COUNTS])


def statistics(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`carry` of `docs` in a struct `row`, the whole counts and the ratios of every whole text; a null has no words.

    A ratio with a zero below is 0.
    """
    row = F.struct(*[docs[c] for c in carry]).alias("row")
    narrow = docs.select(row, docs["text"].alias("_text"))
    schema = f"row {narrow.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    counts = narrow.mapInArrow(_batches, schema)
    return counts.withColumns({name: F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0)) for name, (above, below) in RATIOS.items()})


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * F.col("n_words"))


def _covers(x: np.ndarray, rule: Sequence[Condition], names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        value = x[:, names.index(c.feature)]
        out &= value > c.threshold if c.above else value <= c.threshold
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[Condition]:
    """The conjunction that gains most, one condition after the other."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, chosen = 0.0, None
        for j, name in enumerate(names):
            value = x[inside, j]
            mine = bad[inside]
            cuts = np.unique(np.quantile(np.concatenate([value[mine], value]), np.linspace(0, 1, THRESHOLDS)))
            for above in (True, False):
                take = value[None, :] > cuts[:, None] if above else value[None, :] <= cuts[:, None]
                p, n = (take & mine).sum(axis=1), (take & ~mine).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0.0)
                if gain.max() > best + 1e-9:
                    best = float(gain.max())
                    # Of the cuts that gain nearly as much the strictest, half-way to the next value inside.
                    near = np.flatnonzero(gain >= CLOSE_GAIN * best)
                    k = near[-1] if above else near[0]
                    outside, within = (value[~take[k]], value[take[k]]) if above else (value[take[k]], value[~take[k]])
                    middle = (outside.max() + within.min()) / 2 if len(outside) and len(within) else cuts[k]
                    chosen = Condition(name, above, float(middle))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= _covers(x, [chosen], names)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: Sequence[str] = FEATURES) -> list[list[Condition]]:
    """Ordered rules that reject, from features and labels; every third row is for pruning."""
    prune = np.arange(len(x)) % 3 == 2
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (left & bad & ~prune).sum() >= LEAST_COVERED:
        rule = _grow(x[left & ~prune], bad[left & ~prune], names)
        px, pbad = x[left & prune], bad[left & prune]
        best, kept = -2.0, []
        for n in range(len(rule), 0, -1):
            inside = _covers(px, rule[:n], names)
            p, q = int((inside & pbad).sum()), int((inside & ~pbad).sum())
            worth = (p - q) / (p + q) if p + q else -1.0
            if worth > best:
                best, kept = worth, rule[:n]
        inside = _covers(px, kept, names) if kept else np.zeros(len(px), bool)
        if not kept or (inside & pbad).sum() < LEAST_PRECISION * max(1, inside.sum()):
            break
        all_inside = left & _covers(x, kept, names)
        if (all_inside & bad).sum() < LEAST_COVERED:
            break
        rules.append(kept)
        left &= ~all_inside
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[list[Condition]]:
    """Rules from `docs` (doc_id, text) and `labels` (doc_id, quality: 0 is bad).

    The `rows` labelled ids with the least hash are used, one text of each; null
    ids and labels are left out. Without labels of both kinds there are no rules.
    No more than one row of an id reaches the driver, however many it has.
    """
    picked = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("_bad"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    stats = statistics(some, ["doc_id", "_bad"]).where(~base_failed()).select("row.doc_id", "row._bad", *FEATURES)
    least = stats.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "_bad")).alias("_least")).select("doc_id", "_least.*")
    data = least.toPandas().sort_values("doc_id")
    order = data.sample(frac=1.0, random_state=7) if len(data) else data
    return learn_rules(order[FEATURES].to_numpy(float), order["_bad"].to_numpy(bool))


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """True where a text stays: an ordered chain of conditions over the statistics, the base rules first."""
    chain = F.when(base_failed(), F.lit(False))
    for rule in rules:
        chain = chain.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(False))
    return chain.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: Sequence[Sequence[Condition]], carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Statistics of every row of `docs` with `base_failed` and `kept`.

    A null or empty text has no words, fails the base rules and is not kept.
    Repeated rows are judged alike; a null doc_id passes through; other columns
    are carried only if named. An empty table gives an empty result.
    """
    return statistics(docs, carry).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))
