"""The search index: ranking by brute force, batches, replaced documents, what a search reads."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerwatch.operators import retrieval
from ledgerwatch.operators.search_index import SearchIndex, term_counts

SCHEMA = "section string, chunk_text string, domain string, doc_type string, doc_title string"
TERMS = ["cash", "mule", "str", "filing", "narrative", "structuring", "money"]
QUERIES = {"q1": "STRUCTURING cash STR filing narrative", "q2": "MONEY_MULE str", "q3": "nothing known"}
DOCS = [
    ("d1", "Structuring of cash. Cash deposits, cash!", "AML"), ("d2", "money mule mule device", "AML"), ("d3", "nothing of interest here at all", "FRAUD"),
    ("d4", "Filing of an STR: the narrative of the STR", "FRAUD"), ("d5", "", "AML"), ("d6", None, "AML"), ("d7", "cash " * 5000 + "mule", "FRAUD"),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, d, "POLICY", "title") for k, t, d in rows], SCHEMA)


def words(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def plain(rows, k):
    toks = {d: words(t) for d, t, _ in rows}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for q, text in QUERIES.items():
        scores = Counter()
        for t in set(words(text)) & set(TERMS):
            df = sum(t in x for x in toks.values())
            for d, ws in toks.items():
                if tf := ws.count(t):
                    scores[d] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], start=1):
            out[q, d] = (i, round(s, 6))
    return out


def found(spark, index, k=3, **attributes):
    qs = spark.createDataFrame(list(QUERIES.items()), "query_id string, query_text string")
    return {(r.query_id, r.section): (r["rank"], r.score) for r in index.search(qs, TERMS, k, **attributes).collect()}


def same(got, want):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_counts_of_terms(spark):
    texts = ["b a b", "", None, "one", "x " * 999 + "y", "A-a_a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(term_counts(F.col("t"))).collect()
    assert [{x.term: x.tf for x in r[0]} for r in rows] == [{"a": 1, "b": 2}, {}, {}, {"one": 1}, {"x": 999, "y": 1}, {"a": 3}]


def test_ranking_matches_brute_force(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    assert found(spark, index) == {}
    index.append(frame(spark, DOCS), 0)
    same(found(spark, index), plain(DOCS, 3))
    aml = [d for d in DOCS if d[2] == "AML"]
    same(found(spark, index, domain="AML"), plain(aml, 3))
    assert found(spark, index, domain="NONE") == {} and found(spark, index, doc_type=["POLICY"]) == found(spark, index)


def test_batches_equal_a_full_build(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    old = [("d2", "cash cash filing str", "FRAUD"), ("d7", "money", "AML")]
    index.append(frame(spark, [*old, *DOCS[:1]]), 0)
    index.append(frame(spark, DOCS[1:4]), 1)
    middle = [old[1], *DOCS[:4]]
    same(found(spark, index), plain(middle, 3))
    index.append(frame(spark, DOCS[4:]), 2)
    index.append(frame(spark, old), 2)  # a batch that was committed is not run again
    same(found(spark, index), plain(DOCS, 3))
    same(found(spark, index, domain="FRAUD"), plain([d for d in DOCS if d[2] == "FRAUD"], 3))
    hits = spark.createDataFrame([("d2",), ("d4",)], "section string")
    assert {r.section: r.chunk_text for r in index.texts(hits).collect()} == {d[0]: d[1] for d in DOCS if d[0] in ("d2", "d4")}


def test_a_failed_batch_is_not_seen(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    index.append(frame(spark, DOCS), 0)
    log, index.log.commit = index.log.commit, lambda batch_id: None
    index.append(frame(spark, [("d1", "mule", "AML"), ("d9", "mule", "AML")]), 1)
    same(found(spark, index), plain(DOCS, 3))
    index.log.commit = log
    index.append(frame(spark, [("d9", "mule", "AML")]), 1)
    same(found(spark, index), plain([*DOCS, ("d9", "mule", "AML")], 3))


def test_a_search_reads_no_text_and_few_folders(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    index.append(frame(spark, DOCS), 0)
    plan = index.postings(["cash", "mule"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    qs = spark.createDataFrame(list(QUERIES.items()), "query_id string, query_text string")
    plan = index.search(qs, TERMS)._jdf.queryExecution().toString()
    assert "chunk_text" not in plan and re.search(r"PushedFilters: \[.*In\(term", plan)


def test_vocabulary_covers_every_alert_query():
    known = set(retrieval.alert_vocabulary())
    assert {"aml", "mule", "dormant", "burst", "ip", "str", "narrative", "or", "pep"} <= known
