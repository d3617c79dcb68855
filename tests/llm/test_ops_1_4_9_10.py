"""Line dedup and licences against SQL and small cases; classifiers against held-out labels."""

import math
import pathlib
import zlib

import numpy as np
import pytest

from pulseframe.llm import op1_lines, op4_licenses, op9_quality, op10_toxicity, queries

SCHEMA = "doc_id long, text string, source string, score string, runs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_license_scan"])
def test_matches_sql(spark, tables, folder, name):
    cur = tables.execute(queries.CHECKS[name])
    names = [c[0] for c in cur.description]
    got = sorted(repr(tuple(r[n] for n in names)) for r in queries.QUERIES[name](spark, folder).collect())
    assert got == sorted(map(repr, cur.fetchall()))


def brute_lines(docs, m):
    """Kept text per document: lines in runs of m non-blank lines that start earlier elsewhere, and long single lines."""
    full = {i: [k for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\f\r")] for i, t in docs}
    seen, single, gone = set(), set(), {}
    for i, t in sorted(docs):
        lines, at = t.split("\n"), full[i]
        gone[i] = set()
        for k in range(len(at) - m + 1):
            window = tuple(lines[x] for x in at[k:k + m])
            if window in seen:
                gone[i].update(at[k:k + m])
            seen.add(window)
        for x in at:  # a long line, or a whole document, is a run by itself
            if lines[x] in single and (len(at) == 1 or len(lines[x].split()) > 50):
                gone[i].add(x)
            single.add(lines[x])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


@pytest.mark.parametrize("m", [1, 2, 4])
def test_line_dedup_matches_brute_force(spark, m):
    rng = np.random.default_rng(m)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d"], rng.integers(0, 12)))) for i in range(40)]
    long = ["w " * 60 + str(k) for k in range(3)] + ["v " * 50, "u " * 51]
    docs += [(50 + k, "\n".join(rng.permutation([*long, f"x{k}", f"y{k}"])[:int(rng.integers(1, 6))])) for k in range(12)]
    docs += [(80, "a"), (81, "  a"), (82, "\n a"), (83, "only"), (84, "only"), (85, "first\nonly")]
    docs += [(40, "same\n" * 9), (41, ""), (42, "tail\nsame\nsame\n\nsame\nsame\nend")]
    got = {r.doc_id: r.kept_text for r in op1_lines.dedup(frame(spark, [(i, t, "s") for i, t in docs]), m).collect()}
    assert got == brute_lines(docs, m)


def test_a_long_line_between_other_lines(spark):
    passage = " ".join(f"word{k}" for k in range(80))
    docs = [(k, f"before {k}\n{passage}\nafter {k}", "s") for k in range(3)]
    assert [r.n_removed for r in op1_lines.report(frame(spark, docs)).orderBy("doc_id").collect()] == [0, 1, 1]
    assert [r.n_removed for r in op1_lines.report(frame(spark, docs), long_words=None).collect()] == [0, 0, 0]


def test_line_dedup_odd_rows(spark):
    docs = frame(spark, [(1, None, "s"), (2, "a\nb\nc", "s"), (2, "a\nb\nc", "s"), (None, "x\na\nb", "s"), (3, "q", "s")])
    rows = op1_lines.dedup(docs).collect()
    assert len(rows) == 5
    assert [(r.kept_text, r.n_removed) for r in rows if r.doc_id == 2] == [("a\nb\nc", 0)] * 2
    assert [(r.kept_text, r.n_runs) for r in rows if r.doc_id is None] == [("x", 1)]
    assert op1_lines.report(docs.where("false")).count() == 0


def test_licenses_inherit_from_the_nearest_directory(spark):
    mit = "Released under the MIT License."
    files = spark.createDataFrame([
        ("a/LICENSE", mit, 1), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", 1), ("a/b/c/x", "plain text", 1),
        ("a/y", "other words", 1), ("b/z", "nothing here", 1), ("a/b/own", "many words before it " * 9 + "\n" + mit, 1), (None, mit, 1),
        ("a/e", None, 1), ("a/e", None, 1), ("top", "", 1)], "path string, text string, license int")
    rows = {r.path: (r.license, r.basis, r.directory) for r in op4_licenses.licenses(files).collect()}
    assert rows["a/b/c/x"] == ("Apache-2.0", "inherited", "a/b") and rows["a/y"] == ("MIT", "inherited", "a")
    assert rows["b/z"] == (None, None, None) == rows["top"] and rows["a/e"][1] == "inherited"
    assert rows["a/LICENSE"] == ("MIT", "file", None) and rows["a/b/own"] == ("MIT", "own", None)
    assert op4_licenses.licenses(files.where("false")).count() == 0


def test_look_alike_headers(spark):
    """Each wording gets its own licence, an unknown identifier none of the known ones, and prose nothing."""
    plain = "some words of prose about nothing in particular\n"
    want = {t: n for n, kind, t in op4_licenses.TEMPLATES if kind == op4_licenses.TEXT}
    want |= {"All rights reserved.": "Proprietary", "// SPDX-License-Identifier: Zlib": "Other", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
             "All rights reserved.\nReleased under the MIT License.": "MIT", "See the weather report.": None}
    files = [(f"d{k}/x.c", plain * 5 + t + "\n" + plain * 5, n) for k, (t, n) in enumerate(want.items())]
    rows = op4_licenses.licenses(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()
    got = {r.path: r.license for r in rows}
    # The less common an identifier is beside the word "identifier", the more it weighs: the line may also match nothing.
    unknown = next(p for p, t, _ in files if "Zlib" in t)
    assert got.pop(unknown) in ("Other", None)
    assert got == {p: n for p, _, n in files if p != unknown}


def test_complete_licence_texts(spark):
    """Texts of Debian's folder of licences, each in a directory of its own with a file below it."""
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
             "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
             "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    there = {n: want for n, want in names.items() if (folder / n).is_file()}
    if not there:
        pytest.skip("no folder of licence texts")
    files = [(f"{n}/text", (folder / n).read_text()) for n in there] + [(f"{n}/src/a.c", "int x;") for n in there]
    files += [(f"plain/{k}", f"just words {k}") for k in range(50)]
    rows = {r.path: (r.license, r.basis) for r in op4_licenses.licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {n: rows[f"{n}/text"] for n in there} == {n: (want, "file") for n, want in there.items()}
    assert {n: rows[f"{n}/src/a.c"] for n in there} == {n: (want, "inherited") for n, want in there.items()}


def test_names_of_licence_files(spark):
    mit = "words of an introduction " * 9 + "\nReleased under the MIT License."
    files = spark.createDataFrame([("a/LICENSE.txt", mit), ("a/x", "y"), ("b/licenses.txt", mit), ("b/x", "y")], "path string, text string")
    rows = {r.path: (r.license, r.basis) for r in op4_licenses.licenses(files).collect()}
    assert rows == {"a/LICENSE.txt": ("MIT", "file"), "a/x": ("MIT", "inherited"), "b/licenses.txt": ("MIT", "own"), "b/x": (None, None)}


def accuracy(spark, folder, name, label):
    """Accuracy, recall and precision on the held-out rows."""
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows.values())
    held = [(rows[i].predicted, y) for i, y in truth.items() if rows[i].held_out and y is not None]
    both = sum(p == y == 1 for p, y in held)
    return np.mean([p == y for p, y in held]), both / sum(y for _, y in held), both / max(1, sum(p for p, _ in held))


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    assert accuracy(spark, folder, "op9_quality_classifier", "quality")[0] > 0.95


def test_toxicity_on_held_out_rows(spark):
    right, recall, precision = accuracy(spark, "/root/testdata/sf0.01", "op10_toxicity_segments", "toxic")
    assert right > 0.95 and recall > 0.6 and precision > 0.8


def odd(spark):
    rows = [(i, f"good words here number {i} and more of them" if i % 3 else "bad !!! ### idiot !!! ###", "s") for i in range(90)]
    docs = frame(spark, rows + [(90, None, "s"), (91, "", "s"), (None, "good words", "s"), (5, "good words", "s"), (93, "w " * 50_000, "s")])
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 1 if i % 3 == 0 else 0) for i in range(90)] + [(None, 1, 1), (4, None, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifiers_on_odd_rows(spark):
    docs, labels = odd(spark)
    nine = op9_quality.report(docs, labels).collect()
    assert len(nine) == 95 and all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in nine)
    assert {r.predicted for r in nine if r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3 == 0} == {0}
    kept = op9_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 90").count() == 61
    ten = op10_toxicity.report(docs, labels).collect()
    assert len(ten) == 95 and {r.predicted for r in ten if r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3} == {0}
    assert {r.predicted for r in ten if r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3 == 0} == {1}
    for docs2, labels2 in ((docs.where("false"), labels), (docs, labels.where("false"))):
        assert op9_quality.report(docs2, labels2).count() == op10_toxicity.report(docs2, labels2).count() == docs2.count()


def test_segments_match_the_definition():
    """Best segment first, then the best of what it leaves on either side."""
    def brute(s, a, b):
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return brute(s, a, best[2]) + [(best[2], best[3])] + brute(s, best[3], b)
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.round(rng.normal(-0.3, 1, rng.integers(0, 14)), 6)
        assert sorted((a, b) for a, b, _ in op10_toxicity.segments(s)) == sorted(brute(s.tolist(), 0, len(s)))


def test_log_odds_and_evidence_match_plain_python():
    rng = np.random.default_rng(2)
    corpus, toxic, other = (rng.integers(0, m, 30).astype(float) for m in (400, 12, 60))
    got = op10_toxicity.log_odds(corpus, toxic, other, 14, 70)
    for c, t, o, x in zip(corpus, toxic, other, got):
        prior = op10_toxicity.PRIOR * c / sum(corpus) + op10_toxicity.FLOOR
        delta = math.log((t + prior) / (14 + 2 * prior)) - math.log((o + prior) / (70 + 2 * prior))
        room = abs(delta) - op10_toxicity.SURE * math.sqrt(1 / (t + prior) + 1 / (o + prior))
        assert x == pytest.approx(math.copysign(room, delta) if room > 0 else 0.0)
    for _ in range(100):
        s = np.round(rng.normal(-0.4, 1, rng.integers(1, 25)), 6)
        decay, log_k = 1.3, -2.0
        _, found = op10_toxicity.evidence(s, decay, log_k)
        want = [(a, b - a, len(s) * math.exp(log_k - decay * x)) for a, b, x in op10_toxicity.segments(s)]
        want = [w for w in want if w[2] < 1]  # fewer than one as good expected
        assert [(f["first_word"], f["n_words"]) for f in found] == [w[:2] for w in want]
        assert [f["expected"] for f in found] == pytest.approx([w[2] for w in want])
