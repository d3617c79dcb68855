"""Benchmark decontamination with suffix arrays of the training words.

Each slice of documents gets a suffix array over its words: the suffixes are
sorted by their first words, and every suffix of every test item is looked up
in it by binary search. The range found gives all places of a test window;
places that follow each other in both texts join to the longest verbatim
matches. Only suffixes that begin like some test window enter the array, as no
search can end at another one. Documents meet the test items inside tasks, so
nothing is shuffled; test items larger than ``BLOCK_BYTES`` come in blocks, one pass each.

Words compare by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulseframe.llm.common import byte_table, cut_words, drop_columns, materialize, parts_for, put_back, set_aside, slices

WINDOW = 13
#: Text of test items that one pass holds in every task.
BLOCK_BYTES = 8_000_000
#: Words a suffix must share with the start of a test window to enter the array.
HEAD = 3
WORD_BYTES = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()),
    T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())]))
FOUND = {"n_words": T.LongType(), "hits": T.BinaryType(), "items": T.ArrayType(T.StringType()), "matches": MATCH}


class Windows:
    """Windows of test items as rows of word numbers, sorted for lookups by their first words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(t or "").encode() for _, t in items]
        h, _, bounds = cut_words(texts, WORD_BYTES) if texts else (np.empty(0, np.uint64), None, np.zeros(1, int))
        self.vocabulary, number = np.unique(h, return_inverse=True)
        number = number.astype(np.uint32) + 1
        self.window = window
        places: dict[tuple, list[tuple[str | None, int]]] = defaultdict(list)
        for k, (item, _) in enumerate(items):
            words = number[bounds[k]:bounds[k + 1]].tolist()
            width = min(window, len(words))
            for at in range(len(words) - width + 1) if width else ():
                places[tuple(words[at:at + width])].append((item, at))
        self.words = sorted(places)
        self.places = [places[w] for w in self.words]
        # Heads of 1 to HEAD words, by the head's length.
        self.heads = {n: np.array(sorted({self._mix(w[:n]) for w in self.words if min(len(w), HEAD) == n}), np.uint64)
                      for n in range(1, HEAD + 1)}
        self.low, self.high = self._keys(0), self._keys(0xFFFFFFFF)

    @staticmethod
    def _mix(words) -> int:
        out = 0
        for w in words:
            out = (out * 0x100000001B3 + int(w)) & 0xFFFFFFFFFFFFFFFF
        return out

    def _keys(self, fill: int) -> np.ndarray:
        rows = np.full((len(self.words), self.window), fill, ">u4")
        for k, w in enumerate(self.words):
            rows[k, :len(w)] = w
        return _as_key(rows)


def _as_key(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as strings, whose order is that of the numbers."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def search(texts: list[bytes], test: Windows) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int]]]]:
    """(text, words, hit mask, [(window, first word)]) of each text."""
    h, _, bounds = cut_words(texts, WORD_BYTES)
    n, found = len(h), np.empty(0, int)
    if n and len(test.words):
        at = np.searchsorted(test.vocabulary, h)
        at[at == len(test.vocabulary)] = 0
        number = np.where(test.vocabulary[at] == h, at + 1, 0).astype(np.uint32)
        end = np.repeat(bounds[1:], np.diff(bounds))  # of each word's text
        # Suffixes that begin like a window.
        padded = np.concatenate((number, np.zeros(max(HEAD, test.window), np.uint32)))
        mask, mixed = np.zeros(n, bool), np.zeros(n, np.uint64)
        known = number > 0
        for k in range(1, HEAD + 1):
            mixed = mixed * np.uint64(0x100000001B3) + padded[k - 1:k - 1 + n]
            known = known & (padded[k - 1:k - 1 + n] > 0) & (np.arange(n) + k <= end)
            if len(heads := test.heads[k]):
                live = np.flatnonzero(known)
                spot = np.searchsorted(heads, mixed[live])
                spot[spot == len(heads)] = 0
                mask[live[heads[spot] == mixed[live]]] = True
        suffixes = np.flatnonzero(mask)
        # The suffix array: numbers stop at the text's end.
        rows = np.zeros((len(suffixes), test.window), ">u4")
        for k in range(test.window):
            rows[:, k] = np.where(suffixes + k < end[suffixes], padded[suffixes + k], 0)
        keys = _as_key(rows)
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        first, past = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
        found = np.flatnonzero(past > first)
    hit, by_text = np.zeros(n + 1, np.int32), defaultdict(list)
    if len(found):
        for w in found.tolist():
            for s in suffixes[first[w]:past[w]].tolist():
                hit[s] += 1
                hit[s + len(test.words[w])] -= 1
                t = int(np.searchsorted(bounds, s, "right")) - 1
                by_text[t].append((w, s - int(bounds[t])))
    covered = np.cumsum(hit)[:n] > 0
    for t in range(len(texts)):
        lo, hi = int(bounds[t]), int(bounds[t + 1])
        yield t, hi - lo, covered[lo:hi], by_text.get(t, [])


def _matches(found: list[tuple[int, int]], test: Windows) -> list[dict]:
    """Longest verbatim matches: windows that follow each other on one diagonal of item and document."""
    lines: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for w, at in found:
        for item, start in test.places[w]:
            lines[(item, at - start)].append((start, len(test.words[w])))
    out = []
    for (item, shift), spans in lines.items():
        spans.sort()
        begin, end = spans[0][0], spans[0][0] + spans[0][1]
        for start, size in spans[1:]:
            if start > end:
                out.append({"item_id": item, "item_word": begin, "doc_word": begin + shift, "n_words": end - begin})
                begin = start
            end = max(end, start + size)
        out.append({"item_id": item, "item_word": begin, "doc_word": begin + shift, "n_words": end - begin})
    return sorted(out, key=lambda m: (str(m["item_id"]), m["item_word"], m["doc_word"]))


def _pass(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    """One block of test items against all documents; adds to what earlier blocks found."""
    again = "_hits" in docs.columns
    new = [T.StructField(f"_{k}", v) for k, v in FOUND.items()]
    kept = [f for f in docs.schema.fields if f.name not in {f"_{k}" for k in FOUND}]
    schema = T.StructType(kept + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Windows(items, window)
        for batch in batches:
            names = batch.schema.names
            old = {k: batch.column(names.index(f"_{k}")).to_pylist() for k in FOUND} if again else None
            got = {k: [] for k in FOUND}
            for first, texts in slices(batch):
                for t, n, covered, found in search(texts, test):
                    bits = np.packbits(covered) if covered.any() else np.empty(0, np.uint8)
                    named = {item for w, _ in found for item, _ in test.places[w]}
                    matches = _matches(found, test)
                    if again:
                        before = np.frombuffer(old["hits"][first + t], np.uint8)
                        bits = before if not len(bits) else bits if not len(before) else bits | before
                        named |= set(old["items"][first + t])
                        matches = old["matches"][first + t] + matches
                    for k, v in zip(FOUND, (n, bits.tobytes(), sorted(named, key=str), matches)):
                        got[k].append(v)
            arrays = [batch.column(names.index(f.name)) for f in kept]
            kinds = {"n_words": pa.int64(), "hits": pa.binary(), "items": pa.list_(pa.string()), "matches": pa.list_(pa.struct(
                [("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))}
            arrays += [pa.array(got[k], kinds[k]) for k in FOUND]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [f"_{k}" for k in FOUND])

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _n_words, _hits (bit per word, high bit first; empty if none), _items and _matches.

    A null text has no words and no matches; items without words match nothing.
    Repeated items count once per item_id. Works on empty tables.
    """
    docs = drop_columns(docs, {f"_{k}" for k in FOUND})
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = parts_for(int(total), block_bytes)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        docs = _pass(docs, [tuple(r) for r in part.collect()], window)  # at most about block_bytes
        if k + 1 < blocks:
            docs = materialize(docs, "decontaminate")
    return docs


def verdict(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.05, **options) -> DataFrame:
    """``find`` with n_hit and contaminated: some word is hit, and at least ``ratio`` of the words are."""
    found = find(docs, benchmark, **options)
    bits = F.aggregate(F.split(F.hex("_hits"), ""), F.lit(0), lambda a, c: a + F.bit_count(
        F.coalesce(F.conv(F.when(c != "", c), 16, 10).cast("int"), F.lit(0))))
    found = found.withColumn("_n_hit", F.when(F.length("_hits") > 0, bits).otherwise(F.lit(0)).cast("long"))
    least = round(1 / ratio)
    return found.withColumn("_contaminated", (F.col("_n_hit") > 0) & (F.col("_n_hit") * least >= F.col("_n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, in their own columns."""
    found = verdict(set_aside(docs, "doc_id", "text"), benchmark, **options)
    return put_back(found.where("NOT _contaminated"), docs, "doc_id", "text")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts, the digest of the items found and the verdict of each document, with its longest matches."""
    found = verdict(docs.select(docs["doc_id"], docs["text"]), benchmark, **options)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"), F.col("_matches").alias("matches"))
