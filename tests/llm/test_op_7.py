"""Repeated substrings against brute force."""

import hashlib

import numpy as np
import pytest

from pulseframe.llm import op7_substrings, queries


def brute(docs, length=50):
    data = [(i, (t or "").encode()) for i, t in docs]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, b in data:
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, b in data:
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < order(i):
                mask[s:s + length] = True
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=repr)


def test_query_matches_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(docs)
    assert rows(queries.QUERIES["op7_substring_dedup"](spark, folder)) == want and any(r[3] > 1 for r in want)


@pytest.mark.parametrize("options", [{}, {"pack_bytes": 700, "bucket_bytes": 900, "shard_bytes": 400}, {"pack_bytes": 500, "bucket_bytes": 900, "shard_bytes": 400, "hot_packs": 1}])
def test_random_texts(spark, options):
    rng = np.random.default_rng(7)
    pool = ["".join(rng.choice(list("abc d\x00é"), n)) for n in (49, 50, 51, 80, 130, 300)]
    docs = []
    for i in rng.permutation(60).tolist():
        parts = [pool[k] if rng.random() < 0.6 else "".join(rng.choice(list("xyz uv"), rng.integers(0, 90))) for k in rng.integers(0, len(pool), 4)]
        docs.append((i - 5, "".join(parts)))
    docs += [(3, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (99, None), (100, ""), (101, "a" * 400), (102, "a" * 60), (103, "ab" * 5_000), (104, "ba" * 40)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, pack string")
    got = op7_substrings.dedup(frame, **options)
    assert rows(got) == brute(docs)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert op7_substrings.report(frame).count() == 0


def test_groups_have_all_occurrences_and_are_maximal():
    text = b"#".join([b"xaabcdefgh", b"yaabcdefgz", b"qabcdefgh", b"abcd"])
    arr = np.frombuffer(text, np.uint8)
    begin = np.array([0, 11, 22, 32])
    end = np.array([10, 21, 31, 36])
    found = {(bytes(arr[at[0]:at[0] + depth]), len(at)) for depth, _, at in op7_substrings.maximal_groups(arr, begin, end, least=4)}
    assert found == {(b"abcdefgh", 2), (b"abcdefg", 3), (b"aabcdefg", 2), (b"abcd", 4)}
