"""SimHash near-duplicates by a self-join of binary tries.

Distinct fingerprints are the keys of a binary trie. Two nodes of one level are
walked down together; the differing bits of their paths add up, and a pair
whose sum exceeds the budget is dropped with everything below it. To share the
work, the 64 bits are cut into ``blocks`` blocks: fingerprints that differ in at
most ``budget`` bits agree on some ``blocks - budget`` of them. Each choice of
blocks is a bit order whose trie has those blocks on top, and there both paths
must be equal, so the subtrie under a choice's blocks is a task's group. The
number of blocks grows with the number of fingerprints, and groups that are
still large are cut again by the remaining bits in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.common import components, materialize, slices

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints of one subtrie above which it is cut again.
GROUP_ROWS = 4_096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """Bit majority of the XXH64 of word shingles; no words give 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = 0, max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:last - 1] + 1)).tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    counts = np.zeros(64, np.int64)
    for first in range(0, last, 16_384):  # whole text, in steps of bounded memory
        h = np.array([digest(view[a:b], SEED) for a, b in zip(starts[first:first + 16_384], stops[first:first + 16_384])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp): the signed form of each text's 64-bit fingerprint, and its hash. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(t) for _, texts in slices(batch) for t in texts]
            signed = np.array(fp, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed)], names=["doc_id", "tie", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _tie(docs)).mapInArrow(
        run, "doc_id long, tie long, fp long")


def _tie(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string")).alias("tie")


# -- the trie join inside one group --------------------------------------------

def _forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Indices of the pairs that join two trees of ``parent`` (updated in place)."""
    used = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(k)
    return np.array(used, np.int64)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def trie_links(keys: np.ndarray, starts: np.ndarray, budget: int = BUDGET,
               most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of ``keys`` (uint64) that join all keys of a trie linked within ``budget`` bits.

    ``starts`` are the first positions of the tries, whose keys are sorted and distinct.
    A node is the range of keys under it. Node pairs are walked breadth-first in
    stacks of at most about ``most`` pairs. A pair of nodes whose keys are all in one
    component already is dropped: it could only repeat a link.
    """
    n = len(keys)
    if n < 2:
        return
    starts = np.asarray(starts, np.int64)
    parent = np.arange(n)
    near = np.bitwise_count(keys[1:] ^ keys[:-1])
    close = np.flatnonzero(near <= budget)
    used = close[_forest(n, close, close + 1, parent)]
    if len(used):
        yield used, used + 1
    parent = _roots(parent)
    ends = np.append(starts[1:], n)
    roots = np.stack((starts, ends, starts, ends, np.zeros_like(starts)), 1)
    stack = [(0, roots[ends - starts > 1])]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > most:
            stack.append((depth, pairs[most:]))
            pairs = pairs[:most]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
        if depth == 64:
            small[:] = True
        leaf, pairs = pairs[small], pairs[~small]
        if len(leaf):
            na, nb = leaf[:, 1] - leaf[:, 0], leaf[:, 3] - leaf[:, 2]
            reps = np.repeat(np.arange(len(leaf)), na * nb)
            k = np.arange(len(reps)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = leaf[reps, 0] + k // nb[reps], leaf[reps, 2] + k % nb[reps]
            ok = x < y
            x, y = x[ok], y[ok]
            ok = (np.bitwise_count(keys[x] ^ keys[y]) <= budget) & (parent[x] != parent[y])
            x, y = x[ok], y[ok]
            if len(x):
                used = _forest(n, x, y, parent)
                parent = _roots(parent)
                if len(used):
                    yield x[used], y[used]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        # Where the ones begin in each node's range: keys are sorted, so the next bit is.
        ones = np.concatenate(([0], np.cumsum((keys & bit) != 0)))
        lo1, hi1, lo2, hi2, err = pairs.T
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = (lo1 == lo2)
        children = [np.stack(c, 1) for c in (
            (lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1))]
        cross = np.stack((mid1, hi1, lo2, mid2, err + 1), 1)[~same]
        down = np.concatenate((*children, cross))
        down = down[(down[:, 4] <= budget) & (down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3])]
        down = down[~((down[:, 0] == down[:, 2]) & (down[:, 1] - down[:, 0] == 1))]
        if len(down):
            # Uniform nodes of one component: changes of component inside a range are counted.
            turn = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            one = (turn[down[:, 1] - 1] == turn[down[:, 0]]) & (turn[down[:, 3] - 1] == turn[down[:, 2]])
            down = down[~(one & (parent[down[:, 0]] == parent[down[:, 2]]))]
        if len(down):
            stack.append((depth + 1, down))


# -- groups --------------------------------------------------------------------

def _cuts(bits: list[int], blocks: int) -> list[list[int]]:
    edges = [round(k * len(bits) / blocks) for k in range(blocks + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _choices(bits: list[int], blocks: int, budget: int) -> list[int]:
    return [_mask(sum(c, [])) for c in combinations(_cuts(bits, blocks), blocks - budget)]


def blocks_for(n: int, budget: int = BUDGET) -> int:
    """Blocks with which a choice of them has at least as many values as there are fingerprints per 64."""
    b = budget + 1
    while b < 9 and 2 ** (64 * (b - budget) // b) < n / 64:
        b += 1
    return b


def _join(frame: DataFrame, budget: int, most: int = 300_000) -> DataFrame:
    """Links within the groups of (choice, value): a spanning forest of each.

    A task walks the tries of its groups together, about ``most`` keys at a time.
    """

    def walk(choice: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        keys = fp.view(np.uint64)
        order = np.lexsort((keys, value, choice))
        choice, value, keys = choice[order], value[order], keys[order]
        starts = np.flatnonzero(np.concatenate(([True], (choice[1:] != choice[:-1]) | (value[1:] != value[:-1]))))
        pairs = list(trie_links(keys, starts, budget))
        signed = keys.view(np.int64)
        a, b = ([np.concatenate([p[k] for p in pairs]) for k in (0, 1)] if pairs else [np.empty(0, np.int64)] * 2)
        return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([np.asarray(c) for c in batch.columns]))
            if sum(h.shape[1] for h in held) < most:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield walk(*(np.ascontiguousarray(r) for r in rows[:, :cut]))
            held = [rows[:, cut:]]
        if held and (rows := np.concatenate(held, axis=1)).size:
            yield walk(*(np.ascontiguousarray(r) for r in rows))

    dealt = frame.select("choice", "value", "fp").repartition("choice", "value").sortWithinPartitions("choice", "value")
    return dealt.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` within ``budget`` bits, directly or over others."""

    def keyed(frame: DataFrame, masks: list[int], fixed: int = 0) -> DataFrame:
        out = frame.withColumn("choice", F.explode(F.array(*[F.lit(m | fixed) for m in masks])))
        return out.withColumn("value", F.col("fp").bitwiseAND(F.col("choice"))).select("fp", "choice", "value")

    now = keyed(distinct, _choices(list(range(64)), blocks_for(distinct.count(), budget), budget))
    found = None
    for _ in range(3):
        large = materialize(now.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "trie_large")
        hot = [r.choice for r in large.select("choice").distinct().collect()]  # at most one per choice of blocks
        free = {m: [b for b in range(64) if not (m >> b) & 1] for m in hot}
        hot = [m for m in hot if len(free[m]) > 2 * (budget + 1)]
        if not hot:
            break
        large = large.where(F.col("choice").isin(hot)).drop("n")
        fit = _join(now.join(large, ["choice", "value"], "left_anti"), budget)
        found = fit if found is None else found.unionByName(fit)
        rows, parts = now.join(large, ["choice", "value"]), []
        for m in hot:
            parts.append(keyed(rows.where(F.col("choice") == m).select("fp"), _choices(free[m], budget + 1, budget), m))
        again = parts[0]
        for p in parts[1:]:
            again = again.unionByName(p)
        now = materialize(again.distinct(), "trie_groups")
    rest = _join(now, budget)
    return rest if found is None else found.unionByName(rest)


def _labelled(docs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tie, fp), and (fp, head, root) per fingerprint: its first row and the class it is in.

    The first row has the smallest doc_id, null ids last, and of these the smallest hash of its text.
    """
    fps = materialize(fingerprints(docs), "simhash")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("head")
    nodes = materialize(fps.groupBy("fp").agg(head), "simhash_nodes")
    roots = components(links(nodes.select("fp"), budget), "simhash_links")
    return fps, nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id, n_links): linked documents have the smallest doc_id reachable.

    Equal fingerprints are one node, so copies are never paired. ``n_links`` is the
    number of other nodes the document's class has. A text without words has
    the fingerprint 0 and links like any other; a null doc_id counts only if its class has
    no other id. Repeated rows keep their rows.
    """
    fps, labelled = _labelled(docs, budget)
    label = labelled.groupBy("root").agg(F.min("head.doc_id").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    member = labelled.join(label, "root").select(F.col("fp").alias("_fp"), "component_id", "n_links")
    return fps.join(member, fps["fp"] == member["_fp"]).drop("_fp", "tie")


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id and text hash, in the columns of ``docs``.

    Null ids come last. An id does not name a document: rows of one id, or without one, are told
    apart by their texts; of rows with the same id and text, one stays.
    """
    names = docs.columns
    fps, labelled = _labelled(docs, BUDGET)
    winners = labelled.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("_id"), F.col("head.tie").alias("_tie"))
    kept = docs.join(winners, docs["doc_id"].cast("long").eqNullSafe(winners["_id"]) & (_tie(docs) == winners["_tie"]), "left_semi")
    if not fps.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        mark = max(names, key=len) + "_"  # a name that no column has
        kept = kept.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", mark])
    return kept.select(*[F.col(f"`{c}`") for c in names])
