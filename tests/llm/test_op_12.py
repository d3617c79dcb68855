"""Lexical search against brute force over the terms of whole texts."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from pulseframe.llm import op12_search, queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in words if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_matches_brute_force_and_sql(spark, folder, tables):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = rows(queries.QUERIES["op12_lexical_search"](spark, folder))
    assert got == brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items]) and len(got) > 100
    cur = tables.execute(queries.CHECKS["op12_lexical_search"])
    names = [c[0] for c in cur.description]
    assert got == sorted((tuple(r[names.index(c)] for c in ("item_id", "rank", "doc_id", "score")) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_items": 3}, {"block_bytes": 200, "k": 2}])
def test_odd_tables(spark, options, monkeypatch):
    monkeypatch.setattr(op12_search, "MATCHES", 50)
    rng = random.Random(5)
    words = ["a", "B", "é", "É", "x1", "9", "日本", "a b", "the", "The"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "  ", "'"]) for _ in range(n))
    docs = [(None if k % 11 == 3 else k // 2, make(rng.randrange(30)), "s") for k in range(80)]
    docs += [(500, None, "s"), (501, "", "s"), (502, "... --", "s"), (503, "the " * 60_000 + "end", "s"), *[(504, "a b rare", "s")] * 15, (505, "end", "s")]
    items = [("q1", "The É end"), ("q1", "rare"), ("q2", "x1 x1 x1"), ("q3", None), ("q4", ""), (None, "日本 9"), ("q5", "nowhere"), ("q6", "a b B"), ("q7", make(20))]
    got = rows(op12_search.search(spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3),
                                  spark.createDataFrame(items, "item_id string, text string"), **options))
    assert got == brute([d[:2] for d in docs], items, options.get("k", 10)) and got


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert rows(op12_search.search(d, i)) == []
    assert rows(op12_search.search(docs, items)) == brute([(1, "a b")], [(1, "a")])
