"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded texts, with exception phrases.

Folding lowers letters, maps look-alike letters of other scripts and full-width
forms to Latin ones, and digits and signs inside words to the letters they
stand for. The lexicon is learned from labelled rows: whole words and word
beginnings that toxic texts hold far more often than others. A match that lies in an
exception phrase (the word with a neighbour that clean texts use) does not
count. The weights of the matches, over the length of the text, give the score
through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.components import written
from tanyalah.llm.vectors import least_hashes

LABELLED_ROWS = 20_000
LEXICON_ROWS = 4_000
LEAST_TEXTS = 6
LEAST_RATIO = 20.0
SHORTEST, LONGEST = 4, 8
SMOOTH_WORDS = 20
MOST_WEIGHT = 40.0
GAIN = 0.7
FLUSH = 400_000

# Look-alike letters and the Latin letters they are read as.
LOOKALIKES = dict(zip("абвгдезикмнорстухіјѕԁһԛԝαβγεηικνορτυχωⅰⅼ", "aбbгдe3икmhopctyxijsdhqwaвyeniкvoptuxwil"))
DIGITS = dict(zip("0134578@$", "oieastbas"))
WORD = re.compile(r"[^\W_]+")
AFTER = re.compile(r" [^\W_]+")
# Signs that show nothing: soft hyphens, joiners, zero-width spaces, direction and variation marks.
UNSEEN = re.compile("[\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]+")


def _letters() -> dict[int, str]:
    """Look-alikes in both cases, and every letter whose compatibility form is an ASCII letter or digit."""
    table = {}
    for cp in [*range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0xFF00, 0xFF60), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(cp)).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[cp] = plain
    for strange, latin in LOOKALIKES.items():
        if latin.isascii() and latin.isalpha():
            table[ord(strange)] = table[ord(strange.upper()) if len(strange.upper()) == 1 else ord(strange)] = latin
    return table


FOLD = _letters()
_SIGNS = "".join(re.escape(c) for c in DIGITS)
INSIDE = re.compile(rf"(?<=[^\W\d_])[{_SIGNS}]+(?=[^\W\d_])|(?<![^\W_])[{_SIGNS}](?=[^\W\d_]{{2}})|(?<=[^\W\d_]{{2}})[{''.join(c for c in DIGITS if c.isdigit())}](?![^\W_])")
_UNSIGN = str.maketrans(DIGITS)


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, signs that show nothing gone, and digits or signs within words as letters.

    Letters with accents stay what they are, whether written as one sign or
    two: without them 86 instead of 90 of 97 held-out toxic texts were found.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", UNSEEN.sub("", text)).translate(FOLD)
    text = text.lower()
    return INSIDE.sub(lambda m: m[0].translate(_UNSIGN), text)


class Entry(NamedTuple):
    pattern: str
    whole: bool
    weight: float


class Model(NamedTuple):
    lexicon: list[Entry]
    exceptions: list[str]
    curve: tuple[float, float, float, float]


def _automaton(model: Model):
    found = ahocorasick.Automaton()
    for entry in model.lexicon:
        old = found.get(entry.pattern, ())
        found.add_word(entry.pattern, (*old, (len(entry.pattern), entry.whole, entry.weight)))
    for phrase in model.exceptions:
        old = found.get(phrase, ())
        found.add_word(phrase, (*old, (len(phrase), True, None)))
    if len(found):
        found.make_automaton()
    return found


def matches(found, text: str) -> list[tuple[int, int, float]]:
    """Lexicon matches (start, end, weight) in a folded text, at word beginnings, outside exception phrases.

    Of the matches at one beginning the heaviest counts.
    """
    if not len(found) or not text:
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    n = len(text)
    for last, entries in found.iter(text):
        end = last + 1
        for length, whole, weight in entries:
            start = end - length
            if (start and text[start - 1].isalnum()) or (whole and end < n and text[end].isalnum()):
                continue
            if weight is None:
                spared.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (end, weight)
    if not spared:
        return [(s, e, w) for s, (e, w) in best.items()]
    # A match is spared if a phrase that begins no later ends no earlier: both sorted, one pass.
    spared.sort()
    out, k, reach = [], 0, 0
    for s, (e, w) in sorted(best.items()):
        while k < len(spared) and spared[k][0] <= s:
            reach = max(reach, spared[k][1])
            k += 1
        if e > reach:
            out.append((s, e, w))
    return out


def evidence(found, text: str) -> tuple[float, float, float, int]:
    """Whether anything matches, the weight of the matches over the length in words as a logarithm, and in all; number of matches."""
    folded = fold(text)
    hits = matches(found, folded)
    if not hits:
        return 0.0, 0.0, 0.0, 0
    weight = sum(w for _, _, w in hits)
    return 1.0, math.log(weight / (len(folded.split()) + SMOOTH_WORDS)) + 5, min(weight, MOST_WEIGHT) / 10, len(hits)


def _prefixes(text: str) -> set[str]:
    """Distinct words of a text, marked by a blank at the end, and their beginnings."""
    out = set()
    for word in set(WORD.findall(fold(text))):
        if len(word) >= 3:
            out.add(word + " ")
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            out.add(word[:n])
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def flush():
        for toxic, counter in counts.items():
            if counter:
                keys, values = list(counter), list(counter.values())
                counter.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([toxic] * len(keys)), pa.array(values, pa.int64())], names=["term", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(_prefixes(text))
            if sum(map(len, counts.values())) > FLUSH:
                yield from flush()
    yield from flush()


def _lexicon(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[Entry]:
    """Entries from (term, toxic texts, clean texts), without those to which a shorter beginning gives nearly the same weight."""
    known = {term: (a, b) for term, a, b in rows}
    entries: dict[str, Entry] = {}
    for term in sorted(known, key=lambda t: (len(t.rstrip()), t)):
        a, b = known[term]
        bare = term.rstrip()
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if any(bare[:n] in entries and not entries[bare[:n]].whole and weight < entries[bare[:n]].weight + GAIN for n in range(SHORTEST, len(bare) + 1)):
            continue
        # The longest beginning or word that all the texts share says more than the first.
        longest, growing = term, True
        while growing and not longest.endswith(" "):
            growing = False
            for other, (c, _) in known.items():
                if other.rstrip().startswith(longest) and len(other) == len(longest) + 1 and c >= 0.97 * a:
                    longest, growing = other, True
                    break
        a, b = known[longest]
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        name = longest.rstrip()
        entries[name] = Entry(name, longest.endswith(" "), weight)
    return list(entries.values())


def _word_start(text: str, end: int) -> int:
    """Where the word that ends before `end` begins; `end` itself without one."""
    at = end
    while at and WORD.match(text[at - 1]):
        at -= 1
    return at


def _neighbours(model: Model):
    """Matches with the word before and the word after, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(model)
        for batch in batches:
            phrases, marks = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                own = set()
                for start, end, _ in matches(found, folded):
                    stop = WORD.match(folded, start).end()
                    if start and folded[start - 1] == " " and (begin := _word_start(folded, start - 1)) < start - 1:
                        own.add(folded[begin:stop])
                    if after := AFTER.match(folded, stop):
                        own.add(folded[start:stop] + after[0])
                phrases += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(marks, pa.bool_())], names=["phrase", "toxic"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(model)
        for batch in batches:
            values = [list(evidence(found, text)[:3]) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, lexicon_rows: int = LEXICON_ROWS) -> Model:
    """Lexicon, exceptions and curve from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    The `rows` labelled ids with the least hash are used, one whole text of each.
    The lexicon has at most `lexicon_rows` terms, the likeliest first, and as many exceptions, the commonest first. Null ids,
    labels and texts are left out. Without toxic and clean rows nothing is toxic.
    """
    picked = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("_toxic"))
    picked = least_hashes(picked, "doc_id", rows, picked.count())
    some = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    some = some.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_toxic").alias("_toxic")).select("text", "_toxic")
    some = written(some, "toxic").repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    totals = {r["_toxic"]: r["count"] for r in some.groupBy("_toxic").count().collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return Model([], [], (0.0, 0.0, 0.0, -5.0))
    counts = some.mapInArrow(_terms, "term string, toxic boolean, n long").groupBy("term")
    counts = counts.agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("b"))
    ratio = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))
    strong = counts.where((F.col("a") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO))
    kept = strong.orderBy((F.log(ratio) * F.col("a")).desc(), "term").limit(lexicon_rows).collect()
    model = Model(_lexicon([(r["term"], r["a"], r["b"]) for r in kept], toxic, clean), [], (0.0, 0.0, 0.0, 0.0))
    phrases = some.mapInArrow(_neighbours(model), "phrase string, toxic boolean").groupBy("phrase")
    phrases = phrases.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    fine = phrases.where((F.col("b") >= LEAST_TEXTS) & (F.col("b") / (clean + 1) > F.col("a") / (toxic + 1))).orderBy(F.col("b").desc(), "phrase").limit(lexicon_rows)
    model = model._replace(exceptions=[r["phrase"] for r in fine.collect()])
    points = some.mapInArrow(_evidence(model), "x array<double>, toxic boolean").toPandas()
    return model._replace(curve=_logistic(np.array(points["x"].tolist()), points["toxic"].to_numpy(bool)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights and offset of the regularised logistic curve, by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(z.shape[1]), np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(model)
        for batch in batches:
            values, hits = [], []
            for text in batch.column(1):
                *x, n = evidence(found, text.as_py() or "")
                z = sum(a * b for a, b in zip(model.curve, (*x, 1.0)))
                values.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "n_matches"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5), n_matches for every row of `docs` (doc_id, text).

    A null or empty text has no matches and the score of such texts. Repeated
    rows score alike, a null doc_id passes through, other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(_scores(model), f"doc_id {kind}, score double, n_matches long")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
