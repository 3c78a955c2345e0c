"""URL filter: rules by host and path, else logistic regression on hashed character n-grams.

Everything is built-in functions and MLlib; the rules become one conditional
expression, longest first, so they should be a short list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
FEATURES = 1 << 14
LABELLED_ROWS = 20_000
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first "://" in lower case, and path; both empty without it or for null."""
    at = F.instr(F.coalesce(url, F.lit("")), F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index into `rules` of the longest that fits, else null."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].pattern), rules[k].pattern))
    fits = []
    for k in order:
        rule = rules[k]
        host_fits = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits.append(F.when(host_fits & F.startswith(path, F.lit(rule.path)), F.lit(k)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def _grams(text: Column, mark: str, n: int) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
    return F.transform(starts, lambda k: F.concat(F.lit(mark), F.substring(padded, k, F.lit(n))))


def url_features(frame: DataFrame, gram: int = GRAM, features: int = FEATURES) -> DataFrame:
    """`frame` (host, path) with `_features`: which n-grams of host and of path occur, hashed."""
    grams = F.concat(_grams(F.col("host"), "h", gram), _grams(F.col("path"), "p", gram))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True).transform(frame.withColumn("_grams", grams)).drop("_grams")


def fit_urls(labelled: DataFrame, rows: int = LABELLED_ROWS, gram: int = GRAM, features: int = FEATURES):
    """A model of P(block) from (url, block 0/1); None if not both labels occur.

    At most `rows` labelled rows are used, those with the least hash of the
    url. Rows with a null label or url are left out.
    """
    some = labelled.where("url is not null and block is not null").select("url", F.col("block").cast("double").alias("_label"))
    some = some.orderBy(F.xxhash64("url"), "url", "_label").limit(rows)
    host, path = host_and_path(F.col("url"))
    ready = url_features(some.select(host.alias("host"), path.alias("path"), "_label"), gram, features)
    if ready.select("_label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_guess", probabilityCol="_probability", rawPredictionCol="_raw", maxIter=40, regParam=0.01).fit(ready)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model, gram: int = GRAM, features: int = FEATURES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row of `pages` (page_id, url).

    The verdict is the rule's, else block where the model gives 0.5 or more;
    without a model (None) such rows are allowed with p_block null. A null or
    malformed url has empty host and path and is judged by the model like any
    other. Repeated rows stay; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = split.withColumn("p_block", F.lit(None).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(url_features(split, gram, features)).withColumn("p_block", vector_to_array("_probability")[1])
    pick = lambda field: reduce(lambda rest, k: F.when(F.col("_rule") == k, F.lit(getattr(rules[k], field))).otherwise(rest), range(len(rules)), F.lit(None).cast("string"))
    own = F.when(F.col("p_block") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", pick("pattern").alias("rule"), F.coalesce(pick("verdict"), own).alias("verdict"), "p_block")
