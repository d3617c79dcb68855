"""Ranked lexical search by scanning the documents with an automaton of the items' terms.

The terms of all items go into one Aho-Corasick automaton, each with a blank on both sides.
Documents are mapped to lower case with blanks for everything that is no term, so
one scan of the text finds every occurrence of every term; there is no index of the
documents. A first scan counts documents, terms and document frequencies; a second one counts
term frequencies again, adds each term's share to the items that have it, and keeps every item's
best documents of the task. The best of the tasks are merged in two steps.

Items of more than ``BLOCK_BYTES`` of text, or more than ``BLOCK_ITEMS``, come in blocks, with two scans each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pulseframe.llm.common import best_rows, byte_table, parts_for, slices

BLOCK_BYTES, BLOCK_ITEMS = 8_000_000, 2_000
#: Matches that are counted at a time, and documents whose scores are held at a time.
MATCHES, SCORED = 1_000_000, 256
TERM_BYTES = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def terms_of(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(TERM_BYTES).split())


class Terms:
    """The terms of a block of items: the automaton, and the items of each term."""

    def __init__(self, items: dict):
        self.items = list(items)
        self.terms = sorted(set().union(*items.values()))
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((number[t], k) for k, i in enumerate(self.items) for t in items[i])
        self.owners = np.array([i for _, i in pairs], np.int64)
        self.bounds = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1))
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(f" {t.decode('latin-1')} ", k)
        if self.terms:
            self.automaton.make_automaton()

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text, and (text, term, occurrences) of the items' terms, sorted."""
        data = (b" " + b"  ".join(texts) + b" ").translate(TERM_BYTES)
        ends = np.cumsum([len(t) + 2 for t in texts])  # a text's last blank is before its end
        inside = np.frombuffer(data, np.uint8) != 32
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        sizes = np.diff(np.searchsorted(starts, ends - 1), prepend=0)
        keys, counts = [], []
        if self.terms:
            # Bytes stand for characters of the same number, so the automaton works on bytes.
            found = chain.from_iterable(self.automaton.iter(data.decode("latin-1")))
            while len(part := np.fromiter(islice(found, 2 * MATCHES), np.int64)):
                at, term = part[0::2], part[1::2]
                key, n = np.unique(np.searchsorted(ends, at, "right") * len(self.terms) + term, return_counts=True)
                keys.append(key)
                counts.append(n)
        if not keys:
            none = np.empty(0, np.int64)
            return sizes, none, none, none
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        return sizes, key // len(self.terms), key % len(self.terms), total


class Best:
    """The k best documents of every item seen so far: higher scores, then smaller ids, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [np.empty(0, np.int64)] * 4  # item, score, id is null, id
        self.least = np.ones(items, np.int64)    # a score below this cannot enter

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        new = (item, scores[row, item], missing[row], ids[row])
        item, score, no_id, doc = (np.concatenate(x) for x in zip(self.rows, new))
        order, rank = best_rows(item, score, no_id, doc, self.k)
        self.rows = [x[order] for x in (item, score, no_id, doc)]
        full = rank == self.k - 1
        self.least[self.rows[0][full]] = self.rows[1][full]


def _statistics(docs: DataFrame, block: Terms, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of each term of the block."""
    width = len(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total, df = Terms(shared.value), 0, 0, np.zeros(width, np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                sizes, _, term, _ = held.scan(texts)
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
                df += np.bincount(term, minlength=width)
        live = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(([-2, -1], live)), pa.int64()), pa.array(np.concatenate(([n, total], df[live])), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}  # at most the block's terms
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(width)], np.int64)


def _best(docs: DataFrame, item: T.DataType, shared, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score, part): the best documents of every task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    schema = T.StructType([T.StructField("item_id", item), T.StructField("doc_id", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("part", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = Terms(shared.value), TaskContext.get().partitionId() // 256
        best = Best(len(held.items), k)
        kind = None
        for batch in batches:
            names = batch.schema.names
            kind = kind or batch.column(names.index("_item")).type
            column = batch.column(names.index("doc_id"))
            missing = np.array(column.is_null()).astype(np.int64)
            ids = column.fill_null(0).to_numpy(zero_copy_only=False)
            for first, texts in slices(batch):
                sizes, doc, term, tf = held.scan(texts)
                m = 10 + (90 * sizes.astype(np.int64) * n_docs) // max(n_terms, 1)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                for low in range(0, len(texts), SCORED):
                    size = min(SCORED, len(texts) - low)
                    lo, hi = np.searchsorted(doc, (low, low + size))
                    scores = np.zeros((size, len(held.items)), np.int64)
                    for s in range(lo, hi, 20_000):  # a term of many items makes many shares
                        e = min(s + 20_000, hi)
                        begin, count = held.bounds[term[s:e]], np.diff(held.bounds)[term[s:e]]
                        spread = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                        np.add.at(scores, (np.repeat(doc[s:e] - low, count), held.owners[spread]), np.repeat(gain[s:e], count))
                    rows = slice(first + low, first + low + size)
                    best.add(scores, ids[rows], missing[rows])
        item_no, score, no_id, doc_id = best.rows
        if len(score):
            yield pa.RecordBatch.from_arrays([
                pa.array([held.items[i] for i in item_no.tolist()], kind), pa.array(doc_id, pa.int64(), mask=no_id > 0),
                pa.array(score, pa.int64()), pa.array(np.full(len(score), part), pa.int64())], names=["item_id", "doc_id", "score", "part"])

    rows = docs.select("doc_id", "text", F.lit(None).cast(item).alias("_item")).mapInArrow(run, schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Tasks in groups first, so that no item's merge grows with the number of tasks alone.
    for keys in (["item_id", "part"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, none with a score of 0.

    Equal scores are ranked by doc_id, null ids last; equal rows of ``docs`` are so many documents.
    Rows of ``items`` with one item_id, a null one too, are one item with all their terms. Null
    and empty texts have no terms and find nothing. Only ``doc_id``, ``text`` and ``item_id`` are
    read, whatever other columns there are. Empty tables give an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    items = items.select(items["item_id"].alias("item_id"), items["text"].cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()
    blocks = max(parts_for(int(total["b"]), block_bytes), parts_for(total["n"], block_items))
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held: dict = {}
        for r in part.collect():  # about block_bytes at most
            held.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
        block, shared = Terms(held), spark.sparkContext.broadcast(held)
        found = _best(docs, kind, shared, *_statistics(docs, block, shared), k)
        out = found if out is None else out.unionByName(found)
    return out
