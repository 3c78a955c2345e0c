"""The ten operators against brute force, round trips, held-out rows and awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tanyalah.llm import bagminhash, html_trees, imatch, line_dedup, mixing, ppm, quality_rules, queries, sentencepiece_trie, toxicity, url_filter, words
from tanyalah.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, `count` long, `size` string, `row` string"
LINE = "the same long line of words"
ROWS = [
    (1, None, "a", 1, "x", "y"),
    (2, "", None, 2, "x", "y"),
    (3, f"one two three four five six seven eight nine ten\n{LINE}\n", "a", None, None, None),
    (3, f"one two three four five six seven eight nine ten\n{LINE}\n", "a", None, None, None),
    (None, f"  {LINE.upper()}\t\nother words of a text without a number here", "b", 1, "x", "y"),
    (5, "word " * 30_000, "b", 1, "x", "y"),
    (6, f"short\n{LINE}", "", 1, "x", "y"),
    (7, "\n\n", "b", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = ascii_words(text)
    return Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))


def test_word_hashes_are_those_of_the_words():
    texts = ["a b a", None, "", "héllo\tb\n  b", "b"]
    found = defaultdict(set)
    for lo, _, buf, offsets in words.blocks(pa.array(texts), 4):
        w = words.words_of(buf, offsets)
        for s, e, d, h in zip(w.start, w.end, w.doc, w.hash):
            found[bytes(buf[s:e]).decode()].add((int(h)))
            assert bytes(buf[s:e]).decode() in texts[lo + d]
    assert {k: len(v) for k, v in found.items()} == {"a": 1, "b": 1, "héllo": 1}


def test_quality_counts_equal_brute_force(spark, docs):
    sample = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for row in quality_rules.judge(sample, [], ["doc_id", "text"]).collect():
        text = row["row"]["text"] or ""
        w = ascii_words(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        again = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if ascii_words(x)]
        assert row["n_words"] == len(w) and row["word_chars"] == sum(map(len, w))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert row["n_dup_lines"] == len(lines) - len(set(lines)) and row["n_repeat_words"] == len(again)
        assert row["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert row["kept"] == (not row["base_failed"])


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 2))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4)
    rules = quality_rules.learn_rules(x, bad, ["p", "q"])
    out = np.zeros(4000, bool)
    for rule in rules:
        out |= quality_rules._covers(x, rule, ["p", "q"])
    assert (out == bad).mean() > 0.97


def test_encoding_equals_the_public_encoder(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY_FILE)
    vocabulary = sentencepiece_trie.read_vocabulary(queries.VOCABULARY_FILE)
    odd = [(8, "Hello  world\n x ﬁ ① 1234 ▁ <s> </s> 日本語 \t  ", "a", 1, "x", "y"), (9, "   ", "a", 1, "x", "y")]
    frame = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).select("doc_id", "text")
    frame = frame.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = sentencepiece_trie.decode(sentencepiece_trie.encode(frame, vocabulary), vocabulary).collect()
    assert len(rows) == frame.count()
    assert sorted(map(str, sentencepiece_trie.encode_and_decode(frame, vocabulary).collect())) == sorted(map(str, rows))
    for row in rows:
        assert row["ids"] == model.encode(row["text"] or "")
        assert row["decoded"] == model.decode(row["ids"]) == (row["text"] or "").replace("▁", " ")


def test_pieces_equal_the_public_encoder_over_whole_tables(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY_FILE)
    encoder = sentencepiece_trie.Encoder(sentencepiece_trie.read_vocabulary(queries.VOCABULARY_FILE))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", " ", "\n", "\n\n a", "▁", "a▁", " \n ", "é", "a\nb c", None, "\n"]
    for lo in range(0, len(texts), 100):
        ids, at = encoder.encode(pa.array(texts[lo : lo + 100]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model.encode(t or "") for t in texts[lo : lo + 100]]


def test_bytes_that_form_no_text_become_replacement_characters():
    surface = [" a".encode(), b"b", b"\xc3", b"\xa9", b" "]
    ids, at = np.array([0, 1, 2, 3, 2, 1, 0, 4], np.int32), np.array([0, 2, 4, 4, 6, 6, 8])
    assert sentencepiece_trie._decoded(ids[:4], at[:3], surface).to_pylist() == ["ab", "é"]
    assert sentencepiece_trie._decoded(ids, at, surface).to_pylist() == ["ab", "é", "", "\ufffdb", "", "a "]


def test_trie_sums_to_one_and_equals_brute_force():
    order = 3
    _, _, buf, offsets = next(words.blocks(pa.array(["abracadabra abra", "banana band", "héllo", "", "abab"])))
    gram = ppm.grams(*ppm.padded(buf, offsets, order), order)
    gram, n = np.unique(gram, return_counts=True)
    last = [gram & np.uint64(ppm._ends_with(k + 1)) for k in range(order)]
    tries = [ppm.Trie(ppm.Top(last[shared], n, shared), gram, n, order) for shared in range(order)]
    trie = tries[0]
    seen = defaultdict(Counter)
    for x, times in zip(gram.tolist(), n.tolist()):
        b = x.to_bytes(8, "big")[-order - 1 :]
        for q in range(order + 1):
            seen[b[order - q : order]][b[order]] += times

    def chance(context, symbol, out=frozenset(), q=order):
        if q < 0:
            return 1 / (ppm.SYMBOLS - len(seen[b""]))
        counts = seen.get(context[len(context) - q :] if q else b"")
        if not counts:
            return chance(context, symbol, out, q - 1)
        left = {a: n for a, n in counts.items() if a not in out}
        n, t = sum(left.values()), len(left)
        if symbol in left:
            return left[symbol] / (n + t)
        return (t / (n + t) if t else 1) * chance(context, symbol, out | set(counts), q - 1)

    for context in (b"abr", b"zzz", b"\xfe\xfea", b"xab"):
        symbols = [s for s in range(256) if s != ppm.BEFORE]
        wanted = np.array([int.from_bytes(context + bytes([s]), "big") for s in symbols], np.uint64)
        got = 10 ** trie.log10(wanted)
        assert all(10 ** other.log10(wanted) == pytest.approx(got) for other in tries)
        assert got.sum() == pytest.approx(1)
        assert got == pytest.approx([chance(context, s) for s in symbols])


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, docs, small, monkeypatch):
    import zlib

    if small:
        # Many buckets, which are split.
        for name, value in (("BUCKET_KEYS", 20_000), ("CELL_KEYS", 30_000)):
            monkeypatch.setattr(ppm, name, value)

    frame = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    all_rows = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    cut = lambda t: [w.decode() for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()).split()]
    counts, ends = Counter(), 0
    for i, t in all_rows:
        if not held(i):
            counts.update(cut(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    want = defaultdict(list)
    for i, t in all_rows:
        w = cut(t)
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((ends + 1) / (total + distinct + 1))
        want[i].append((held(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, pytest.approx(base, rel=1e-9)))
    rows = ppm.score_texts(frame).collect()
    assert len(rows) == len(all_rows)
    # The whole trie in one piece.
    _, _, buf, offsets = next(words.blocks(pa.array([t for i, t in all_rows if not held(i)]), 1 << 40))
    gram, n = np.unique(ppm.grams(*ppm.padded(buf, offsets, ppm.ORDER), ppm.ORDER), return_counts=True)
    trie = ppm.Trie(ppm.Top(gram & np.uint64(ppm._ends_with(2)), n, 1), gram, n, ppm.ORDER)
    scores = defaultdict(list)
    for i, t in all_rows:
        data = np.frombuffer(t.encode(), np.uint8)
        scores[i].append(pytest.approx(trie.log10(ppm.grams(*ppm.padded(data, np.array([0, len(data)]), ppm.ORDER), ppm.ORDER)).sum(), rel=1e-6))
    for r in rows:
        assert tuple(r)[1:6] in want[r["doc_id"]] and r["score"] in scores[r["doc_id"]] and r["score"] < 0


def test_answers_are_joined_with_keys_cut_once(monkeypatch):
    """No Spark: a block asks, gets its own keys back as answers, and sums them per text."""
    made = []
    block_keys = ppm._block_keys
    monkeypatch.setattr(ppm, "PART_BYTES", 64)
    monkeypatch.setattr(ppm, "_block_keys", lambda kind, *a: made.append(kind) or block_keys(kind, *a))
    texts = ["", "a b a", "\u00e9t\u00e9 " * 9, None, "a b c d e f g h", "x" * 200, " \n", "Last A"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])
    buckets, facts = (3, 5), (ppm.ORDER, ppm.SHARED)
    rows = next(iter(ppm._texts(iter([batch])))).to_pandas()
    asked = next(iter(ppm._ask(*facts, buckets)(iter([batch])))).to_pandas()
    value = {ppm.WORD: lambda k: (k % np.uint64(7)).astype(np.int64), ppm.GRAM: lambda k: (k % np.uint64(11)).astype(np.float32)}
    asked["data"] = [ppm._packed(value[kind](ppm._unpacked(data, np.uint64))) for kind, data in zip(asked["kind"], asked["data"])]
    parts = len(made)
    made.clear()
    got = ppm._join("bigint", *facts, buckets, 2.0, 1)(pd.concat([rows, asked])).set_index("doc_id")
    assert parts > 4 and len(made) == parts  # before: twice as many
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        at = np.array([0, len(data)])
        counts = value[ppm.WORD](words.words_of(ppm.LOWER[data], at).hash)
        assert got["n_tokens"][i] == len(counts) + 1 and got["n_known"][i] == (counts > 0).sum() + 1
        assert got["base_score"][i] == pytest.approx((np.log10(np.append(counts, 1) + 1) - 2).sum())
        assert got["score"][i] == value[ppm.GRAM](ppm.grams(*ppm.padded(data, at, ppm.ORDER), ppm.ORDER)).sum()


def test_places_of_keys_that_share_a_slot():
    rng = np.random.default_rng(3)
    most = np.uint64(2**64 - 1)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(n % 3 * 8)
        unique = ppm.distinct_keys([keys, keys[::2], np.append(keys, most)])
        assert (unique == np.unique(np.append(keys, most))).all()
        index, other = ppm._Index(unique), rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
        assert (index.find(unique) == np.arange(len(unique))).all()
        assert (index.find(other) == [np.flatnonzero(unique == k)[0] if k in unique else -1 for k in other]).all()
        assert ppm._Index(keys[:0]).find(np.append(other, most)).max() == -1
        sums = ppm._Sums()
        for part in (keys, keys[:1], keys):
            sums.add(part)
        want = Counter([*keys.tolist(), *keys[:1].tolist(), *keys.tolist()])
        assert dict(zip(*(x.tolist() for x in sums.merge()))) == want


def test_fingerprints(spark, docs, none):
    rows = imatch.fingerprint_and_edit(docs).collect()
    assert len(rows) == len(ROWS) and imatch.fingerprint_and_edit(none).count() == 0
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    following = dict(zip(sorted(texts), [*sorted(texts)[1:], min(texts)]))
    prints = defaultdict(set)
    edited_closer = 0
    for r in imatch.fingerprint_and_edit(frame).collect():
        text, after = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        half = len(text) // 2
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[text].add(r["fingerprint"])
        edited_closer += r["near_edited"] >= r["near_next"]
    assert all(len(v) == 1 for v in prints.values()) and edited_closer > 0.95 * len(texts)


def test_likeness_equals_brute_force_with_a_large_family(spark):
    """Every term counted by itself over distinct texts, with a family of copies and one of near copies of a third of the rows each."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    n = frame.count()
    base = [f"family{k}" for k in range(120)]
    family = [(10**6 + k, " ".join([*base[: k % 120], f"edit{k}", *base[k % 120 + 1 :]])) for k in range(n)]
    copies = [(2 * 10**6 + k, " ".join(f"copied{x} often" for x in range(60))) for k in range(n)]
    frame = frame.unionByName(spark.createDataFrame(family + copies, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    ids = sorted(texts)
    breaks = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: set(breaks.split(t.lower())) - {""}
    df = Counter(w for t in set(texts.values()) for w in terms(t))
    most = max(2, int(0.02 * len(set(texts.values()))))
    edited = {i: texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in zip(ids, [*ids[1:], ids[0]])}
    every = sorted(set(df).union(*map(terms, edited.values())))
    hashes = {w: h for w, h in spark.createDataFrame([(w,) for w in every], "w string").selectExpr("w", "xxhash64(w)").collect()}

    def filled(text):
        own = {w for w in terms(text) if 2 <= df[w] <= most}
        above = sorted((w for w in terms(text) if df[w] > most), key=lambda w: (int(df[w] / most).bit_length(), hashes[w]))
        own |= set(above[: max(0, imatch.FILL - len(own))])
        out = defaultdict(set)
        for h in (hashes[w] & (2**64 - 1) for w in own):
            for scale in range(imatch.SCALES):
                if any(h >> (48 + 2 * s) & 3 for s in range(scale)):
                    break
                out[scale, h >> (3 * scale) & 7].add(h)
        return dict(out) or {"all": terms(text)}

    def alike(a, b):
        return sum(a.get(k) == b.get(k) for k in {*a, *b}) / len({*a, *b}) if any(map(len, [*a.values(), *b.values()])) else 1.0

    prints = {i: filled(t) for i, t in texts.items()}
    near = defaultdict(list)
    for r in imatch.fingerprint_and_edit(frame).collect():
        i, j = r["doc_id"], ids[(ids.index(r["doc_id"]) + 1) % len(ids)]
        assert r["near_edited"] == pytest.approx(alike(prints[i], filled(edited[i]))) and r["near_next"] == pytest.approx(alike(prints[i], prints[j])), i
        near[i // 10**6].append(r["near_next"])
    assert np.mean(near[1]) > 0.5 and np.mean(near[2]) > 0.9


def test_buckets_of_the_next_document(spark, monkeypatch):
    """A third of null ids and one id of a third are split over buckets, and every row still finds the next."""
    monkeypatch.setattr(imatch, "BUCKET_BYTES", 40)
    rows = [(None, f"none {k}") for k in range(100)] + [(7, f"hot {k}") for k in range(100)] + [(k * k, f"other {k}") for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = frame.select(F.coalesce("doc_id", F.lit(imatch.NO_ID)).alias("_id"), F.xxhash64("text").alias("_tie"))
    size = sum(len(t) for _, t in rows)
    for quantiles in (1, 4, 8):
        found = keyed.withColumn("_bucket", imatch._bucket(keyed, size, quantiles)).collect()
        numbers = [r["_bucket"] for r in sorted(found, key=lambda r: (r["_id"], r["_tie"]))]
        assert numbers == sorted(numbers)
        assert quantiles == 1 or max(Counter(numbers).values()) < 60
    ordered = [t for _, _, t in sorted((imatch.NO_ID if i is None else i, h, t) for i, t, h in frame.select("doc_id", "text", F.xxhash64("text")).collect())]
    want = dict(zip(ordered, [*ordered[1:], ordered[0]]))
    got = imatch.with_next(frame, imatch.lexicon(frame), 8).select("text", "next.text").collect()
    assert {r[0]: r[1] for r in got} == want and len(got) == len(rows)


def test_common_terms_by_list_and_by_join(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    frame = frame.unionByName(frame)
    listed = imatch.lexicon(frame)
    monkeypatch.setattr(imatch, "MOST_LISTED", 1)
    joined = imatch.lexicon(frame)
    assert listed.above == joined.above and listed.bytes == joined.bytes and sum(map(len, listed.above)) > 1


def test_half_of_a_long_text_is_like_it(spark):
    """Texts of 3,000 terms in the band, each shared with one text far from it."""
    half = [" ".join(f"t{k}x{x}" for x in range(3000)) for k in range(15)]
    frame = spark.createDataFrame([(k, half[k % 15] + f" own{k}") for k in range(30)], "doc_id long, text string")
    rows = imatch.fingerprint_and_edit(frame).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 15


def test_mixing(docs, none):
    assert mixing.mix_sources(none).count() == 0
    rows = mixing.mix_sources(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect())) and len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = mixing.mixed_rows(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)


def test_targets_fill_up_to_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights, caps, left = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 20, "b": 2000, "c": 1000, None: 200}, 1610 * 1.5
    want, open_ = {}, set(weights)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > caps[s]}
        if not full:
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    assert got == pytest.approx(want)


def test_line_dedup(docs, none):
    assert line_dedup.with_kept_lines(none).count() == 0
    rows = {r["doc_id"]: r for r in line_dedup.with_kept_lines(docs).collect()}
    assert rows[3]["_kept"].count(LINE) == 1 and rows[6]["_kept"] == "short" and rows[6]["_n_dropped"] == 1
    assert rows[None]["_kept"] == "other words of a text without a number here"
    assert rows[1]["_n_lines"] == 1 and rows[7]["_n_lines"] == 3 and rows[5]["_bits"] is None
    assert line_dedup.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("name", list(queries.LLM_ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.LLM_QUERIES[name](spark, SF)
    want = con.sql(queries.LLM_ORACLES[name]).df()
    assert sorted(map(tuple, got.toPandas()[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_near_duplicates_equal_brute_force(spark, docs, none):
    assert bagminhash.near_duplicates(none).count() == 0
    base = [f"w{k}" for k in range(200)]
    planted = [(1000 + k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(0, 60, 3)] + [(2000, " ".join(base)), (2001, " ".join(base[:40]))]
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            if texts[a] == texts[b] or both and both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame).collect()}
    assert got == {i: root(i) for i in ids}
    kept = bagminhash.one_of_each(frame).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({root(i) for i in ids})
    # Names of the operator's own columns; rows of one id with different texts: the least text hash stays.
    clash = frame.where("doc_id < 40").selectExpr("doc_id", "text", "7 as _doc", "'d' as _digest", "map('a', doc_id) as _row", "'r' as _rep")
    clash = clash.union(clash).union(clash.where("doc_id = 3").selectExpr("doc_id", "'another text of five words here' as text", "_doc", "_digest", "_row", "_rep"))
    one = bagminhash.one_of_each(clash)
    assert one.columns == clash.columns and {r["_doc"] for r in one.collect()} == {7}
    assert [r["doc_id"] for r in one.collect()].count(3) <= 1
    odd = bagminhash.near_duplicates(docs).collect()
    assert len(odd) == len(ROWS) and {r["class_id"] for r in odd if r["doc_id"] in (1, 2)} == {1}


def test_a_family_of_edited_copies_equals_brute_force(spark):
    """Edits of one source, most pairs below and many near the threshold, and the source itself."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(150)]
    texts = {0: " ".join(base)}
    for i in range(1, 160):
        words_ = list(base)
        for at in rng.choice(150, rng.integers(0, 7), replace=False):
            words_[at] = f"edit{i}x{at}"
        texts[i] = " ".join(words_)
    del texts[0]
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in range(1, a):
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(frame).collect()}
    assert got == {i: root(i) for i in texts} and 10 < len(set(got.values())) < 140


def test_pairs_left_by_pruning_are_compared(spark):
    """Pairs whose luck lies between 4 of all texts and 4 of those that pruning leaves, all in one bucket."""
    luck = "pmod(xxhash64(id), 1L << 52) / double(1L << 52)"
    chosen = [r[0] for r in spark.range(100_000).where(f"{luck} between 0.015 and 0.045").limit(40).collect()]
    others = [r[0] for r in spark.range(100_000).where(f"{luck} > 0.3").limit(360).collect()]
    # 84 to 96 of 100 shingles in common: likenesses around 0.8. The others share 20 of 100 with all.
    sets = {i: set(range(20)) | set(range(1000 * (n + 1), 1000 * (n + 1) + 80)) for n, i in enumerate(others)}
    for n in range(20):
        own = -1000 * (n + 1)
        sets[chosen[2 * n]] = set(range(own, own + 100))
        sets[chosen[2 * n + 1]] = set(range(own + 4 + n % 13, own + 104 + n % 13))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 10 <= len(want) < 20
    bucket = spark.createDataFrame([(1, i, 100, i == others[0]) for i in sets], "_key long, _rep long, _size long, _first boolean")
    signed = spark.createDataFrame([(i, [1] * 8) for i in sets], "_rep long, _sig array<short>")
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "_rep long, _set array<long>")
    got = defaultdict(set)
    for node, component in bagminhash._waves(bucket, signed, frame, 0.8, 4).collect():
        got[component].add(node)
    assert {tuple(sorted(v)) for v in got.values() if len(v) > 1} == want


def test_signatures_estimate_weighted_similarity():
    a, b = np.arange(50, dtype=np.uint64), np.arange(10, 60, dtype=np.uint64)
    na, nb = np.arange(50) % 4 + 1, np.arange(10, 60) % 7 + 1
    registers = 4000
    sig = bagminhash.signatures(np.repeat([0, 1], 50), words.mix(np.concatenate([a, b])), np.concatenate([na, nb]), 2, registers)
    x, y = dict(zip(a.tolist(), na)), dict(zip(b.tolist(), nb))
    keys = {*x, *y}
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}}


def test_main_text_of_new_layouts(spark):
    model = html_trees.fit_pages(html_trees.training_pages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 200))
    page = """<html><body><div id="cookie-notice">We use cookies. Accept all of them now.</div><header><h1>Site</h1></header>
    <div class="menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></div>
    <main><article><h1>Title &amp; more</h1><p>First paragraph of the story, with words enough to be one.
    <p>Second   paragraph&nbsp;here, also with a number of words.</p></article></main>
    <aside class="sidebar"><h3>Related</h3><p>Another story that is not this one, but has some words.</p></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story, it was long and good.</p></div></section>
    <footer>&copy; 2020 Site. All rights.</footer><script>var a="<p>x</p>";</script></body></html>"""
    frame = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (None, "v", "", 5), (4, "w", "<p", 5)], "page_id long, url string, html string, text long")
    got = {r["page_id"]: r["text"] for r in html_trees.extract(frame, model).collect()}
    assert got == {1: "Title & more First paragraph of the story, with words enough to be one. Second paragraph here, also with a number of words.", 2: "", None: "", 4: ""}


def test_siblings_of_a_long_page_are_counted():
    page = "<body>" + "<p>words of a text.</p>" * 450 + "<footer>legal words</footer></body>"
    nodes = html_trees.parse(page)
    same = html_trees.features(nodes, {})[:, 8]
    assert [same[k] for k, x in enumerate(nodes) if x.tag == "footer"] == [pytest.approx(1 / 451)]
    assert all(same[k] == pytest.approx(450 / 451) for k, x in enumerate(nodes) if x.tag == "p")


def test_formulas_and_fallbacks_are_text():
    page = "<body><p>As <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> says</p><div><object data=x><p>in the fallback</p></object><svg/>after</div><script>no</script></body>"
    nodes = html_trees.parse(page)
    assert html_trees.joined_text(nodes, np.ones(len(nodes), bool)) == "As E=mc says in the fallback after"
    assert {x.tag for x in nodes} == {"body", "p", "div"}


@pytest.mark.parametrize("fit", [quality_rules.fit_rules, toxicity.fit_toxicity])
def test_one_row_of_an_id_reaches_the_driver(spark, monkeypatch, fit):
    rows = [(k % 40 if k < 80 else 7, f"you zorgle number {k} has ten or more different words in this text w{k}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    seen, whole = [], type(frame).toPandas

    def counted(self):
        seen.append(whole(self))
        return seen[-1]

    monkeypatch.setattr(type(frame), "toPandas", counted)
    fit(frame, labels)
    assert [len(x) for x in seen] == [40]


def test_toxicity(spark):
    clean = [(k, f"a nice day number {k} with flowers and some trees w{k % 17}") for k in range(300)]
    bad = [(1000 + k, f"you are a zorgle number {k} w{k % 17}") for k in range(60)]
    frame = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in bad], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame, labels)
    new = [(1, "what a z0rgle you are"), (2, "a zоrgle"), (3, "a zorglebert is a fine tree"), (4, None), (None, ""), (6, "flowers")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert (got[1], got[2], got[4], got[None], got[6]) == (1, 1, 0, 0, 0)
    assert toxicity.fit_toxicity(frame, labels.limit(0)).lexicon == []


def test_urls(spark):
    labelled = spark.createDataFrame([(f"http://{h}.org/{k}", b) for k in range(60) for h, b in (("casino-win", 1), ("library", 0))], "url string, block int")
    model = url_filter.fit_urls(labelled)
    urls = [(1, "http://Example.com/en/1?x"), (2, "https://www.example.com/en/"), (3, "http://a.b.net/fr/x#y"), (4, "http://casino-win.org/zz"), (5, "http://library.org/a"), (6, None), (7, "no host"), (8, "http://x.com"), (9, "http://notexample.com/en/1")]
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), queries.URL_RULES, model).collect()}
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("a.b.net", "/fr/x", "net/fr/", "block") and got[4][2:] == (None, "block") and got[5][2:] == (None, "allow")
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:3] == ("x.com", "", None) and got[9][2:] == ("com/", "allow")


def test_empty_tables(none):
    vocabulary = sentencepiece_trie.read_vocabulary(queries.VOCABULARY_FILE)
    assert quality_rules.judge(none, []).count() == 0
    assert sentencepiece_trie.encode(none, vocabulary).count() == 0
    assert ppm.score_texts(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not round_trip").isEmpty()
