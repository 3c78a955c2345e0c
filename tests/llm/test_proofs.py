"""Brute force, timing and clashing names for the operators that SQL cannot check as a whole."""

from __future__ import annotations

import itertools
import math
import random
import time

import duckdb
import numpy as np
import pytest

from tanyalah.llm import html_trees, line_dedup, queries, toxicity, url_filter
from tanyalah.llm.vectors import least_hashes

SF = "/root/testdata/sf0.01"


def pieces(page):
    return [p for _, p in sorted(q for node in html_trees.parse(page) for q in node.pieces)]


def test_markup_never_becomes_text():
    assert pieces("<p title=it's>hello") == ["hello"]
    assert pieces("<p title='a>b' x=\"<\">in</p>out") == ["in", "out"]
    assert pieces("<div <p>x") == ["x"] and pieces("x<b class='") == ["x"]
    assert pieces("x <!-- a > b --> y <!doctype html> z <?php ?>w</ >") == ["x ", " y ", " z ", "w"]
    assert pieces("a < b and c <1 <b>x</b>") == ["a < b and c <1 ", "x"]
    assert pieces("<script>var a='</scriptx>';</script >t<head>u") == ["t", "u"]


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<p title='", "<!x ", "<head>", "</script ", "<script>", '<b x="', "</foo ", "<li>", "<foo><p>", "<!--", "a<", "<td><foo>"])
def test_long_broken_pages_take_seconds(unit):
    begin = time.perf_counter()
    html_trees.parse(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - begin < 5


def plain_matches(entries, exceptions, text):
    """Every entry sought by itself."""
    best, spared = {}, []
    for pattern, whole, weight in [*entries, *[(e, True, None) for e in exceptions]]:
        at = text.find(pattern)
        while at >= 0:
            end = at + len(pattern)
            if not (at and text[at - 1].isalnum()) and not (whole and end < len(text) and text[end].isalnum()):
                if weight is None:
                    spared.append((at, end))
                elif at not in best or weight > best[at][1]:
                    best[at] = (end, weight)
            at = text.find(pattern, at + 1)
    return sorted((s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in spared))


def test_matches_equal_a_search_for_every_entry():
    rng = random.Random(4)
    for _ in range(300):
        parts = ["ab", "abc", "b", "ca", "cab", "a"]
        entries = {p: toxicity.Entry(p, rng.random() < 0.5, w) for p, w in zip(rng.sample(parts, 3), rng.sample(range(1, 10), 3))}
        exceptions = [" ".join(rng.choices(parts, k=2)) for _ in range(2)]
        text = "".join(rng.choice(["a", "b", "c", " ", " "]) for _ in range(60))
        found = toxicity._automaton(toxicity.Model(list(entries.values()), exceptions, (0, 0, 0, 0)))
        assert sorted(toxicity.matches(found, text)) == plain_matches(entries.values(), exceptions, text)


def test_a_long_text_of_one_exception_takes_seconds():
    found = toxicity._automaton(toxicity.Model([toxicity.Entry("zorgle", True, 5.0)], ["some zorgle"], (0, 0, 0, 0)))
    begin = time.perf_counter()
    assert toxicity.evidence(found, "some zorgle " * 80_000)[3] == 0
    assert time.perf_counter() - begin < 5


def test_disguised_words_fold_to_the_word():
    for word in ("zo\u200brgle", "zorg\u00adle", "z0rgl3", "Z\u041eRGLE", "\uff5a\uff4f\uff52\uff47\uff4c\uff45", "zor\u2060gle\ufeff"):
        assert toxicity.fold(word) == "zorgle"
    assert toxicity.fold("zo\u0301rgle") == toxicity.fold("z\u00f3rgle") == "z\u00f3rgle"


def test_neighbours_of_any_length():
    long = "w" * 500
    model = toxicity.Model([toxicity.Entry("zorgle", True, 5.0)], [], (0, 0, 0, 0))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [f"{long} zorgle {long}", "zorgle"], "toxic": [False, True]})
    got = set(next(iter(toxicity._neighbours(model)(iter([batch])))).column(0).to_pylist())
    assert got == {f"{long} zorgle", f"zorgle {long}"}


def test_held_out_toxicity(spark):
    """Labels of the held-out rows were never learned from."""
    folder = SF.replace("0.01", "0.1")
    rows = queries.toxicity_scores(spark, folder).where("held_out").join(queries.table(spark, folder, "labels"), "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert toxic and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_and_urls_of_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).count() == 0
    some = spark.createDataFrame([(1, "zorgle", "x"), (None, None, "y")], "doc_id long, text string, score string")
    assert [r["predicted"] for r in toxicity.score_toxicity(some, model).collect()] == [0, 0]
    pages = spark.createDataFrame([], "page_id long, url string, host string, rule string")
    fitted = url_filter.fit_urls(spark.createDataFrame([], "url string, block int"))
    assert url_filter.judge_urls(pages, queries.URL_RULES, fitted).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/x", "h", "r")] * 2 + [(2, None, "h", "r")], pages.schema)
    got = url_filter.judge_urls(twice, queries.URL_RULES, fitted).collect()
    assert [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])][:2] == [(1, "a.com", "/x", "com/", "allow")] * 2
    assert len(got) == 3


URL_SQL = """
with parts as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), split as (
  select page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from parts
), rules(rule, verdict) as (values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), fits as (
  select page_id, rule, verdict from split, rules
  where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, position('/' in rule)))
  qualify row_number() over (partition by page_id order by length(rule) desc, rule) = 1
)
select page_id, host, path, rule, verdict from split left join fits using (page_id)
"""


def test_urls_equal_sql_where_a_rule_fits(spark):
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = {r[0]: r[1:] for r in db.sql(URL_SQL).fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.url_verdicts(spark, SF).collect()}
    assert got.keys() == want.keys() and sum(w[2] is not None for w in want.values()) > 50
    for page, (host, path, rule, verdict) in want.items():
        assert got[page][:3] == (host, path, rule)
        assert got[page][3] == verdict if rule else got[page][3] in ("allow", "block")


def test_lines_of_tables_with_the_operators_own_names(spark):
    rows = [(1, "one shared long line\nfirst own line here", 7, "a", "b", 5), (2, "one shared long line\nother own line here", 8, "a", "b", 5), (2, "one shared long line\nother own line here", 8, "a", "b", 5), (None, None, 9, "a", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc int, _split string, bits string, n_chars int")
    out = line_dedup.deduplicated(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, rows[0][1], 7, "a", "b", len(rows[0][1])), *[(2, "other own line here", 8, "a", "b", 19)] * 2, (None, None, 9, "a", "b", None)], key=str)


def test_least_hashes_are_those_of_a_full_sort(spark):
    frame = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in frame.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").limit(200).collect()]
    assert [r[0] for r in least_hashes(frame, "doc_id", 200, 5000).collect()] == want
    assert least_hashes(frame, "doc_id", 9000, 5000).count() == 5000


def test_best_decoding_equals_enumeration():
    """All ways to fix whole subtrees or to let a node's parts decide for themselves, at the decoder's cost."""
    rng = random.Random(6)
    for _ in range(40):
        nodes = [html_trees.Node("body", None)]
        for _ in range(rng.randint(1, 6)):
            nodes.append(html_trees.Node("div", rng.choice(nodes)))
        weights = []
        for k, node in enumerate(nodes):
            node.order = k
            if rng.random() < 0.8:
                node.pieces.append((k, "text"))
            weights.append(rng.uniform(-2, 2))
        held = [w if n.pieces else 0.0 for w, n in zip(weights, nodes)]
        best = -math.inf
        for states in itertools.product("kdm", repeat=len(nodes)):
            if any(n.parent and states[n.parent.order] != "m" and states[n.order] != states[n.parent.order] for n in nodes):
                continue
            cost = sum(html_trees.MIXED_COST for s, n in zip(states, nodes) if s == "m" and n.children)
            best = max(best, sum(abs(w) if s == "m" else w if s == "k" else -w for s, w in zip(states, held)) - cost)
        keep = html_trees.decode(nodes, np.array(weights))
        # The cheapest way to state what the decoder chose.
        def price(node):
            inside = [node]
            for n in inside:
                inside += n.children
            uniform = {bool(keep[n.order]) for n in inside if n.pieces}
            own = held[node.order] if keep[node.order] else -held[node.order]
            split = own + sum(price(c) for c in node.children) - (html_trees.MIXED_COST if node.children else 0.0)
            whole = sum(held[n.order] if keep[n.order] else -held[n.order] for n in inside)
            return max(whole, split) if len(uniform) < 2 else split

        assert price(nodes[0]) == pytest.approx(best)
