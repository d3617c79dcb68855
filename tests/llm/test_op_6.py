"""Fingerprints against sets of paragraphs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.llm import op6_fingerprints, queries


def units(line):
    """Up to eight characters that are not blank, with the blanks behind them."""
    blank, at = " \t\n\r\f\v", 0
    while at < len(line) and line[at] in blank:
        at += 1
    while at < len(line):
        end = at
        while end < len(line) and end - at < 8 and line[end] not in blank:
            end += 1
        while end < len(line) and line[end] in blank:
            end += 1
        yield line[at:end]
        at = end


def paragraphs(text):
    """Pieces by going through the units of each line."""
    out = set()
    for line in text.split("\n"):
        held = []
        for unit in units(line):
            held.append(unit)
            if len(held) == 20 or len(held) >= 12 and unit[-1] == " " and unit[-2] in ".!?,:aeo":
                out.add("".join(held))
                held = []
        out |= {"".join(held)} if held else set()
    return out


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    """Rows by brute force; ``docs`` in descending order."""
    out = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), pytest.approx(likeness(t, edited)), pytest.approx(likeness(t, after)), edited)
    return out


def check(rows, docs):
    want = expected(docs)
    assert len(rows) == len(docs)
    seen = {}
    for r in rows:
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id][:4], r.doc_id
        for text, mark in ((dict(docs)[r.doc_id], r.fingerprint), (want[r.doc_id][4], r.edited_fingerprint)):
            assert seen.setdefault(text, mark) == mark


def test_query_matches_brute_force(spark, folder):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    check(queries.QUERIES["op6_document_fingerprints"](spark, folder).collect(), docs)


@pytest.mark.parametrize("range_rows", [2, 1000])
def test_odd_rows(spark, range_rows):
    docs = [(9, "é" * 7), (8, ""), (5, "a\nb\nc\nd"), (4, "a\nb\nx\ny"), (3, "\n".join(f"line {i}" for i in range(900)) + "\n \n"),
            (2, "Long. " * 300 + "End!"), (-7, "a\nb\nc\nd"), (None, "last")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs[::-1]], "doc_id long, text string, next string, d int")
    rows = op6_fingerprints.fingerprints(frame, range_rows)
    check(rows.select("*", F.col("edited.likeness").alias("near_edited"), F.col("next.likeness").alias("near_next")).collect(), docs)
    five = rows.where("doc_id = 5").first()
    assert len(five.next.only_a) == len(five.next.only_b) == 2
    many = rows.where("doc_id = 3").first()
    assert len(many.next.only_a) == 900 and many.next.larger and not five.next.larger


def test_null_single_and_empty(spark):
    frame = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = op6_fingerprints.report(frame).first()
    assert (row.n_chars, row.near_edited, row.near_next) == (0, 1.0, 1.0) and row.fingerprint == row.edited_fingerprint
    assert op6_fingerprints.report(frame.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b\nc")], "doc_id long, text string")
    assert op6_fingerprints.report(twice).count() == 3


def test_retries_go_on_until_all_is_recovered(spark):
    """Digests that differ in few bits share their cells until a retry deals by those bits."""
    near = [1 << k for k in range(64)]
    near = [x - (1 << 64) if x >> 63 else x for x in near]
    sets = [(near[27:31], near[30:33]), (near, []), (near[:40], near[20:]), ([0, 1, 2, 3], [3]), ([], []), ([7], [7])]
    frame = spark.createDataFrame(sets, "a array<long>, b array<long>")
    frame = frame.withColumn("sa", op6_fingerprints.sketch("a")).withColumn("sb", op6_fingerprints.sketch("b"))
    rows = [r.to for r in op6_fingerprints.compare(frame, "a", "b", "sa", "sb", "1", "to").collect()]
    for (a, b), r in zip(sets, rows):
        a, b = set(a), set(b)
        assert (sorted(r.only_a), sorted(r.only_b)) == (sorted(a - b), sorted(b - a))
        assert r.likeness == (pytest.approx(len(a & b) / len(a | b)) if a | b else 1.0)


def test_half_a_text_is_seen_at_every_length(spark, folder):
    rows = op6_fingerprints.report(spark.read.parquet(f"{folder}/documents.parquet").where("size(split(text, ' ')) >= 20"))
    n, unseen = rows.agg(F.count("*"), F.count_if(F.col("near_edited") == 0)).first()
    assert n > 50 and unseen < 0.01 * n


def test_pieces_meet_again_behind_an_insertion(spark):
    draw = random.Random(6)
    line = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(2000))
    frame = spark.createDataFrame([(line,), ("new words put here " + line,)], "text string")
    one, two = (set(r[0]) for r in frame.select(op6_fingerprints.digests(F.col("text"))).collect())
    assert len(one & two) > 0.8 * len(one)
