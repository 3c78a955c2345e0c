"""Every stage of the pipeline against a plain calculation, each on what the one before it kept."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tanyalah.llm import mixing, ppm, quality_rules, queries

SF = "/root/testdata/sf0.001"
PASSAGE = "the very same line of a notice that many documents share"


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_by_rules(rows, rules):
    out = []
    for row in rows:
        text, w = row["text"] or "", cut(row["text"])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        lines = [x for x in text.split("\n") if cut(x)]
        counts = {name: sum(text.count(chr(b)) for b in chars) for name, chars in quality_rules._FLAGS.items()}
        counts |= {
            "n_words": len(w),
            "word_chars": sum(map(len, w)),
            "n_lines": text.count("\n") + 1,
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}),
            "n_distinct_words": len(set(w)),
            "n_stutters": sum(a == b for a, b in zip(w, w[1:])),
        }
        value = counts | {name: counts[a] / counts[b] if counts[b] else 0.0 for name, (a, b) in quality_rules.RATIOS.items()}
        bad = len(w) < 10 or 100 * counts["n_repeat_words"] > 20 * len(w)
        bad = bad or any(all((value[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        out += [] if bad else [row]
    return out


def without_lines(rows):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    holders = defaultdict(set)
    order = lambda row: math.inf if row["doc_id"] is None else row["doc_id"]
    for row in rows:
        for line in (row["text"] or "").split("\n"):
            holders[key(line)].add(order(row))
    out = []
    for row in rows:
        stay = [x for x in (row["text"] or "").split("\n") if len(key(x)) < 10 or order(row) == min(holders[key(x)])]
        text = None if row["text"] is None else "\n".join(stay)
        out.append(row | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def one_of_each(rows):
    """One row a text, the least id first; of linked texts the first."""
    first = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        first.setdefault(row["text"] or "", row)
    texts = list(first)
    sets = [Counter(zip(*(w[k:] for k in range(5)))) for w in map(cut, texts)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = sum((sets[a] & sets[b]).values())
            if both and 10 * both >= 8 * (sets[a].total() + sets[b].total() - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [first[t] for i, t in enumerate(texts) if root(i) == i]


def mix(rows):
    size = {id(r): len(cut(r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[id(r)] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, list(sources)
    while open_:
        level = (1.5 * sum(own.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * own[s]]
        target |= {s: 2 * own[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in target]
    out = []
    for s in sources:
        # Classes of size by powers of two, then a hash of id and text.
        salt = lambda r: hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}/{r['text'] or ''}".encode()).hexdigest()[:2]
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (max(1, size[id(r)].bit_length()), salt(r), size[id(r)], r["doc_id"] or -1))
        start = int(hashlib.md5(((s or "") + mixing.SEED).encode()).hexdigest()[:8], 16) / 2**32
        step = target[s] / own[s] if own[s] else 0.0
        for k, row in enumerate(mine):
            out += [row] * (math.floor((k + 1) * step + start) - math.floor(k * step + start))
    return out


def same(got, want):
    return Counter(tuple(r.items()) for r in got) == Counter(tuple(r.items()) for r in want)


def test_every_stage_equals_a_plain_calculation(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(f"w{k}" for k in range(80))
    planted = [
        (10_001, words, "xx", "web", len(words)),
        (10_002, words + " end", "xx", "web", len(words) + 4),
        (10_003, words, None, None, None),
        (10_004, f"{PASSAGE}\n" + " ".join(f"a{k}" for k in range(30)), "xx", None, 1),
        (10_005, " ".join(f"b{k}" for k in range(30)) + f"\n  {PASSAGE.upper()}\t", "xx", "", 1),
        (None, f"{PASSAGE}\n" + " ".join(f"c{k}" for k in range(900)), "xx", "web", 1),
        (10_006, None, "xx", "web", 0),
        (10_007, "", "xx", "web", 0),
        (10_008, "again and again " * 40, "xx", "web", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    plain = {"quality_rules": lambda rows: kept_by_rules(rows, rules), "line_dedup": without_lines, "near_dedup": one_of_each, "mixing": mix}
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        got, want = [r.asDict() for r in kept.collect()], plain[name](rows)
        assert same(got, want), name
        # The stage did something, and clean documents stay.
        assert 0 < len(got) and got != rows
        rows, docs = got, spark.createDataFrame(got, docs.schema)
    assert {10_001, 10_004, None} <= {r["doc_id"] for r in rows} and not {10_002, 10_003, 10_006, 10_008} & {r["doc_id"] for r in rows}

    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY_FILE)
    encoded = [r.asDict() for r in corpus_pipeline.encoded(spark, docs, SF).collect()]
    assert len(encoded) == len(rows) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in encoded)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == Counter((r["doc_id"], tuple(model.encode(r["text"]))) for r in rows)


def test_null_and_equal_ids_spread_over_blocks(spark, monkeypatch):
    """A third of the rows without an id and a third with one id: no block of a mix holds many of them."""
    seen = []
    narrow = mixing._hex
    monkeypatch.setattr(mixing, "_hex", lambda column, n: seen.append((column, n)) or narrow(column, n))
    frame = spark.range(9000).selectExpr("case id % 3 when 0 then null when 1 then 7 else id end as doc_id", "concat('text of ', id) as text", "'web' as source")
    assert mixing.mix_sources(frame).count() == 9000
    column, digits = seen[0]
    salted = frame.select("doc_id", narrow(column, digits).alias("salt"))
    for kind in ("doc_id is null", "doc_id = 7"):
        assert salted.where(kind).groupBy("salt").count().agg({"count": "max"}).first()[0] < 60
    assert [mixing.salt_digits(n) for n in (0, 1 << 26, (1 << 26) + 1, 1 << 34)] == [2, 2, 3, 4]


def test_scans_of_one_job_are_split_alike(spark):
    """The number of cores that scans are split by is fixed before the first of them, a given one stays."""
    before = spark.conf.get(ppm.SCAN_CORES, None)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    try:
        spark.conf.unset(ppm.SCAN_CORES)
        ppm.score_texts(docs)
        assert int(spark.conf.get(ppm.SCAN_CORES)) == spark.sparkContext.defaultParallelism
        spark.conf.set(ppm.SCAN_CORES, 3)
        assert ppm.score_texts(docs).count() == 20 and spark.conf.get(ppm.SCAN_CORES) == "3"
    finally:
        spark.conf.unset(ppm.SCAN_CORES)
        if before is not None:
            spark.conf.set(ppm.SCAN_CORES, before)
