"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query runs once to warm up and is then timed twice, from building the
plan to the last row, into a sink that drops the rows; the better time counts. The named queries of
$BENCH_QUERIES (comma-separated) are run, or all.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tanyalah.operators.answer import SCALAR_OPERATIONS, ask, supports, understand  # noqa: E402
from tanyalah.plans import derived  # noqa: E402
from tanyalah.plans.registry import QUERIES  # noqa: E402


def start(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    begin = time.perf_counter()
    run()
    return time.perf_counter() - begin


def ask_each(spark: SparkSession, sf_dir: str) -> tuple[int, float]:
    """The scalar phrases of the question table, asked one at a time."""
    items = derived.table(spark, sf_dir, "lineitem")
    phrases = []
    for phrase, _ in derived.PHRASES:
        intent = understand(items, phrase)
        able = intent.operation in SCALAR_OPERATIONS and not intent.wants_row
        if able and supports(items, intent.operation, intent.column):
            phrases.append(phrase)

    def run():
        for phrase in phrases:
            ask(items, phrase).collect()

    return len(phrases), timed(run)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = start(cpus)
    seconds = {}
    for name in names:
        drain(QUERIES[name](spark, sf_dir))
        runs = [timed(lambda: drain(QUERIES[name](spark, sf_dir))) for _ in range(2)]
        seconds[name] = round(min(runs), 3)
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if not chosen:
        questions = derived.questions(spark, sf_dir).count()
        asked, each = ask_each(spark, sf_dir)
        report |= {
            "questions_per_second": round(questions / seconds["classify_intent"]),
            "answer_many": {"questions": questions, "seconds": seconds["answer_many"]},
            "ask_each": {"questions": asked, "seconds": round(each, 3)},
        }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
