"""Helpers that the operators of this package share."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.session import materialize, work_dir

#: Bytes of text a task turns into arrays at a time; it bounds the memory of a Python worker.
SLICE_BYTES = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text, null as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def unit(*cols) -> Column:
    """A repeatable number in (0, 1) from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)


def drop_columns(df: DataFrame, names: set[str]) -> DataFrame:
    """Without the columns that an operator is about to add (names compare without case)."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with marks put behind until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others as one column ``_rest``, so that no name of theirs can clash."""
    read = {n.lower() for n in needed}
    rest = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() not in read]
    return docs.select(*[docs[n].alias(n) for n in needed], (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def put_back(result: DataFrame, docs: DataFrame, *needed: str, added: tuple[str, ...] = (), dropped: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` in their order, without the dropped ones, and the added ones, for rows of ``set_aside``."""
    read = {n.lower(): n for n in needed}
    out = [F.col(read[c.lower()]).alias(c) if c.lower() in read else F.col(f"_rest.c{i}").alias(c)
           for i, c in enumerate(docs.columns) if c.lower() not in dropped]
    return result.select(*out, *added)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows with about ``limit`` bytes; null is empty.

    One longer text is a run of its own: texts are never cut.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    first, held, size = 0, [], 0
    for i in range(batch.num_rows):
        t = texts[i].as_py() or b""
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1024)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        for key, by in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, by, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def cut_words(texts: list[bytes], table: bytes, classes: bytes | None = None,
              heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: 64-bit hashes, lengths in bytes, and the bounds of each text's words.

    ``table`` maps bytes to bytes (256 of them); what it maps to a blank
    separates words. With ``classes``, a word also ends where the class of the
    mapped byte changes. Text ``i`` has the words ``bounds[i]:bounds[i + 1]``.
    With ``heads`` the hashes are rows: of the words, and of their first bytes of those numbers.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = (b" ".join(texts) + b" ").translate(table)
    kind = np.frombuffer(data.translate(classes) if classes else data, np.uint8)
    data = np.frombuffer(data, np.uint8)
    if not classes:
        kind = (kind != 32).view(np.uint8)
    turn = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
    start, end = turn[:-1], turn[1:]
    inside = kind[start] > 0
    start, end = start[inside], end[inside]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    if heads:
        h = np.stack([h, *((sums[np.minimum(start + k, end)] - sums[start]) * down[start] + np.uint64(k) for k in heads)])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    return h, end - start, bounds


def byte_table(keep: Callable[[int], bool], lower: bool = True) -> bytes:
    """A table for ``cut_words``: bytes of words stay (A-Z lower-cased), the others become blanks."""
    fold = lambda b: b + 32 if lower and 65 <= b <= 90 else b
    return bytes(fold(b) if keep(fold(b)) else 32 for b in range(256))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``: rows (node, root).

    Large-star and small-star rounds: each round is a grouping by node, and every
    round's edges are written to the shared folder. Minima are taken before the
    shuffle, and a node's neighbours are never gathered. Ends when a round
    changes nothing.
    """
    now = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = materialize(small.where("a <> b"), name)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == before:
            break
        before = (mark.n, mark.h)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def best_rows(group: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k first rows of each group, in order, and their ranks from 0.

    Higher scores come first, then smaller ids; ids that are missing come last.
    """
    order = np.lexsort((ids, no_id, -score, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[rank < k], rank[rank < k]


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


# -- learning from labelled rows -------------------------------------------------

def fold(doc_id: Column, modulus: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, bound: int, usable: Column) -> dict[int, int]:
    """doc_id -> 0/1 of at most ``bound`` labelled rows, those with the smallest hashes of their ids.

    Rows without id or label are no examples; an id labelled twice counts with its larger label.
    """
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return {r.doc_id: r.y for r in rows.collect()}


def add_up(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of float64 vectors sent as rows (block, values); ``width`` is fixed, so the result is bounded."""
    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = 0
        for v in pdf["values"]:
            out = out + np.frombuffer(zlib.decompress(v), np.float64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "values": [zlib.compress(out.tobytes(), 1)]})

    rows = parts.groupBy("block").applyInPandas(total, "block int, values binary").collect()
    out = np.zeros(width)
    for r in rows:
        v = np.frombuffer(zlib.decompress(r["values"]), np.float64)
        out[r["block"] * len(v):(r["block"] + 1) * len(v)] = v
    return out


def as_blocks(values: np.ndarray, blocks: int = 64) -> pa.RecordBatch:
    """A task's sums for ``add_up``: its non-zero blocks, compressed."""
    cut = values.astype(np.float64).reshape(blocks, -1)
    live = np.flatnonzero(cut.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(live, pa.int32()), pa.array([zlib.compress(cut[k].tobytes(), 1) for k in live], pa.binary())], names=["block", "values"])
