"""The pipeline stage by stage: what goes, what stays, and the columns."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import op2_simhash, op3_decontamination, op9_quality
from pulseframe.llm.common import read


def test_stages_do_what_their_operators_say(spark, tmp_path, folder):
    docs = read(spark, folder, "documents")
    names = docs.columns
    ids, frames = [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        frames.append(docs)
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == names
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    good = {r.doc_id for r in op9_quality.report(frames[0], read(spark, folder, "labels")).where("predicted = 1").collect()}
    assert set(ids[0]) == good and len(ids[0]) < frames[0].count()
    groups = {r.doc_id: r.component_id for r in op2_simhash.report(frames[1]).collect()}
    assert set(ids[1]) == set(groups.values()) and len(ids[1]) < len(ids[0])
    bad = {r.doc_id for r in op3_decontamination.report(frames[2], read(spark, folder, "benchmark")).where("contaminated").collect()}
    assert set(ids[2]) == set(ids[1]) - bad
    assert max(Counter(ids[3]).values()) == 2 and set(ids[3]) <= set(ids[2])
    slots = defaultdict(list)
    for r in docs.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert Counter(ids[4]) == Counter(ids[3]) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text for r in frames[0].collect()}
    assert all(texts[r.doc_id] == r.text for r in docs.collect())


def test_empty_table(spark, folder):
    docs = read(spark, folder, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_near_duplicates_keep_a_document_of_every_class_without_ids(spark):
    """Null and repeated ids do not name a document: every text that is no copy stays, once."""
    text = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (5, text[2]), (5, text[3]), (None, text[4]), (7, text[4]), (7, text[4]), (9, text[2]),
            (None, text[5]), (None, text[5]), (5, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(None, text[0]), (None, text[1]), (5, text[2]), (5, text[3]), (7, text[4]), (None, text[5]), (5, None)])


CLASHING = ("_doc_id", "_source", "_own_size", "size", "SIZE2", "copies", "_s", "_b", "_block", "_tie", "_before", "_own_score", "score", "_hits", "_n_words", "_rest", "c0", "a.b", "u", "p", "_time")


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, stage):
    """Null ids and texts, repeated rows, and columns named like the operators' own."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(30).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(
        docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("source", F.lit(""))).alias(c) for c in CLASHING])
    name, run = corpus_pipeline.STAGES[stage]
    found = run(spark, docs, sf_dir)
    replaced = {"size"} if name == "sharding" else set()
    rows = found.collect()
    kept = [c for c in docs.columns if c not in replaced]
    assert rows and found.columns[:len(kept)] == kept and set(docs.columns) <= set(found.columns)
    for r in rows:
        for c in CLASHING:
            if c not in replaced:
                assert r[c] == f"{c}:{r['source'] or ''}"
