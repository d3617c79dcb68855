"""Near-duplicates, decontamination, mixing and sharding against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseframe.llm import op2_simhash, op3_decontamination, op5_mixing, op8_sharding, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], SCHEMA)


def odd_rows():
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    return [(1, base, "a"), (2, base, None), (3, None, "b"), (4, "", "a"), (5, "word", "b"), (5, "word", "b"),
            (6, " ".join(f"w{k % 977}" for k in range(60_000)), "a"), (None, base, "c"), (7, "ÄÖ\x0bÜ\x00x", "a")]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    keys = sorted(set(f for _, f in fps))
    arr, parent = np.array(keys, np.uint64), list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    at = {k: root(i) for i, k in enumerate(keys)}
    low = {}
    for d, f in fps:
        if d is not None:
            low[at[f]] = min(low.get(at[f], d), d)
    return {(d, f"{f:016x}", low.get(at[f])) for d, f in fps}


def test_simhash_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_classes([(r.doc_id, brute_simhash(r.text)) for r in docs.collect()])
    got = queries.QUERIES["op2_simhash_near_dedup"](spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want and len(got) == docs.count()


def test_simhash_odd_rows_and_keep_first(spark):
    docs = frame(spark, odd_rows())
    got = op2_simhash.report(docs).collect()
    assert len(got) == len(odd_rows())
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == brute_classes([(d, brute_simhash(t)) for d, t, _ in odd_rows()])
    kept = op2_simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7]
    empty = docs.where("false")
    assert op2_simhash.report(empty).count() == 0 and op2_simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("group_rows", [4, 4096])
def test_trie_links_find_every_class(spark, group_rows):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = {int(s) for s in seeds}
    for s in seeds.tolist():  # chains of near keys, some dense
        x = s
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << b
            keys.add(x)
    fps = [(k, k) for k in sorted(keys)]
    frame = spark.createDataFrame([(k - 2**64 if k >= 2**63 else k,) for k in keys], "fp long")
    pairs = op2_simhash.links(frame, group_rows=group_rows).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in pairs)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in pairs:
        a, b = root(r.a & (2**64 - 1)), root(r.b & (2**64 - 1))
        parent[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for k in keys:
        groups[root(k)].add(k)
    want = defaultdict(set)
    for k, _, c in brute_classes(fps):
        want[c].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_decontamination_matches_sql(spark, tables, folder):
    got = queries.QUERIES["op3_benchmark_decontamination"](spark, folder)
    cur = tables.execute(queries.CHECKS["op3_benchmark_decontamination"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want
    assert any(r[names.index("contaminated")] for r in want)


@pytest.mark.parametrize("block_bytes", [200, 8_000_000])
def test_decontamination_odd_rows_and_blocks(spark, block_bytes):
    docs = frame(spark, odd_rows())
    items = spark.createDataFrame([
        ("a", "TWO three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), ("b", "word"), ("b", "word"),
        ("c", None), ("d", "--"), ("e", "w3 w4"), (None, "one two three four five six seven eight nine ten eleven twelve, thirteen")],
        "item_id string, text string")
    rows = {r.doc_id: r for r in op3_decontamination.report(docs, items, block_bytes=block_bytes).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].contaminated) == (14, 14, True)
    assert (rows[3].n_words, rows[3].n_hit, rows[3].n_items, rows[3].contaminated) == (0, 0, 0, False)
    assert rows[5].n_hit == 1 and rows[5].n_items == 1
    assert rows[6].n_hit == 2 * sum(1 for k in range(60_000) if k % 977 == 3) and not rows[6].contaminated
    assert [(m.item_word, m.doc_word, m.n_words) for m in rows[1].matches if m.item_id == "a"] == [(0, 1, 13)]
    kept = op3_decontamination.decontaminate(docs, items, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert op3_decontamination.report(docs.where("false"), items).count() == 0
    assert op3_decontamination.report(docs, items.where("false")).where("contaminated").count() == 0


def fill(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def test_mixing_targets_and_words(spark, folder):
    rows = queries.QUERIES["op5_source_mixing"](spark, folder).collect()
    again = queries.QUERIES["op5_source_mixing"](spark, folder).collect()
    assert sorted(rows) == sorted(again) and len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert r.taken in (0, r.size, 2 * r.size)
    want, taken, largest = fill(sizes), Counter(), Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_mixing_tree_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(op5_mixing, "CHUNK_ROWS", 20)
    monkeypatch.setattr(op5_mixing, "FAN_IN", 4)
    docs = frame(spark, [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)])
    rows = op5_mixing.mix_report(docs).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 7 for r in rows)
    odd = frame(spark, odd_rows())
    report = op5_mixing.mix_report(odd).collect()
    assert len(report) == len(odd_rows())
    mixed = op5_mixing.mix(odd)
    assert mixed.columns == odd.columns
    count = Counter(r.doc_id for r in mixed.collect())
    assert count[6] == next(r.copies for r in report if r.doc_id == 6)
    assert op5_mixing.mix_report(odd.where("false")).count() == 0 and op5_mixing.mix(odd.where("false")).count() == 0


def test_sharding(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_sharding_tree"](spark, folder).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_follows_weights_and_odd_rows(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = op8_sharding.topology(6, per_rack=2, racks=2)
    heavy = [leaf._replace(weight=3.0) if leaf.shard == 0 else leaf for leaf in tree]
    rows = ids.select(op8_sharding.shard_of([F.col("doc_id")], tree).alias("a"), op8_sharding.shard_of([F.col("doc_id")], heavy).alias("b")).collect()
    share = Counter(r.b for r in rows)
    assert share[0] / len(rows) == pytest.approx(3 / 8, abs=0.02) and share[5] / len(rows) == pytest.approx(1 / 8, abs=0.02)
    # Only region0 changes its weight, and in it only rack0: others never gain.
    assert not [r for r in rows if r.a != r.b and r.b in (4, 5)]
    assert not [r for r in rows if r.a in (2, 3) and r.b in (2, 3) and r.a != r.b]
    docs = frame(spark, odd_rows())
    out = op8_sharding.shard(docs, op8_sharding.topology(40))
    assert out.count() == len(odd_rows()) and out.where("doc_id = 3").first().text_crc32 == 0
    assert out.where("grown_shard IS NOT NULL").count() == 0
    assert op8_sharding.shard(docs.where("false"), op8_sharding.topology(40)).count() == 0
