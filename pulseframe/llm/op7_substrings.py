"""Suffix-array dedup: repeats of at least 50 bytes across documents, by maximal repeat groups.

A string of ``LENGTH`` bytes has an anchor: of the ``GRAM``-byte pieces in it, the
first with the smallest hash. Equal strings have equal anchors, so the strings of one
anchor, a stretch of text called a context, can be handled apart from all others:

1. Documents are packed, compressed, and written once. Each pack sends its anchors' hashes,
   four bytes each, to hash buckets, which answer what anchors occur in two documents.
2. Packs send the distinct contexts of those anchors to shards by anchor. Contexts of an
   anchor that very many packs have are sent as single strings, by the string's own hash,
   so that no anchor fills a shard.
3. A shard sorts the suffixes of its contexts, takes the common prefix of neighbours,
   and scans them with a stack for the common-prefix intervals of at least ``LENGTH``
   bytes. An interval whose suffixes all follow the same byte is part of a longer repeat and
   is dropped; the others are the maximal repeat groups, with all their occurrences.
4. Each context learns what the groups cover with an owner of a smaller doc_id, and the packs
   cut their documents.

Contexts, and strings within a pack, are told apart by 64-bit hashes; suffixes compare byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.common import _powers, materialize, parts_for, slices

LENGTH, GRAM = 50, 24
#: Text of the table per pack, per bucket of anchors and per shard of contexts.
PACK_BYTES, BUCKET_BYTES, SHARD_BYTES = 1_000_000, 48_000_000, 8_000_000
#: Packs with an anchor above which its contexts are sent as single strings.
HOT_PACKS = 5_000
_NULL_ID = np.iinfo(np.int64).max


# -- packs -----------------------------------------------------------------------

def pack(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(pack, ids, sizes, data): runs of whole documents; null texts are empty, null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch, limit=pack_bytes):
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 32) + serial]), pa.array([ids[first:first + len(texts)]], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([squeeze.compress(b"".join(texts))], pa.binary())],
                    names=["pack", "ids", "sizes", "data"])
                serial += 1

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "pack long, ids array<long>, sizes array<long>, data binary")


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all ``width``-byte strings of ``data``."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums, down = _sums(data)
    h = sums[width:] - sums[:n]
    h *= down[:n]
    return _mix(h)


def _stretches(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[begin:end]``."""
    sums, down = _sums(data)
    return _mix((sums[end] - sums[begin]) * down[begin])


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=sums[1:], dtype=np.uint64)
    sums[1:] *= up[:-1]
    np.cumsum(sums[1:], out=sums[1:])
    return sums, down


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Pack:
    """A pack's text with the anchor of every string of ``LENGTH`` bytes within one document."""

    def __init__(self, ids: list[int | None], sizes: list[int], data: bytes):
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if sum(sizes) else b"", np.uint8)
        self.ids = np.array([_NULL_ID if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        n = len(self.text)
        gram = _hashes(self.text, GRAM)
        # Smallest hash, and of equal ones the first, in every window of the pieces of a string.
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        span, width = LENGTH - GRAM + 1, 1
        while width < span and len(low):
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            width += step
        self.starts = np.arange(len(low), dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        inside = doc[self.starts] == doc[self.starts + LENGTH - 1] if len(low) else np.empty(0, bool)
        self.starts = self.starts[inside]
        anchor = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Contexts: runs of strings with one anchor.
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(self.starts) != 1))) if len(anchor) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.begin = self.starts[first]
        self.end = self.starts[np.append(first[1:], len(anchor)) - 1] + LENGTH if len(first) else first
        self.gram = gram[anchor[first]] if len(first) else np.empty(0, np.uint64)
        self.doc = doc[self.begin] if n else first
        self.unique, self.which = np.unique(self.gram, return_inverse=True)

    def parts(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places in ``unique``) of the anchors."""
        bucket = (self.unique >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for places in np.split(order, cut) if len(order) else ():
            yield int(bucket[places[0]]), places


def _of(batch: pa.RecordBatch) -> Iterator[tuple[int, Pack, dict]]:
    for k in range(batch.num_rows):
        row = {c: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}
        yield row["pack"], Pack(row["ids"], row["sizes"], row["data"]), row


# -- anchors of two documents ------------------------------------------------------

def _anchors(packs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, _ in _of(batch):
                # Documents of the pack with the anchor: whether more than one.
                low, high = np.full(len(text.unique), _NULL_ID), np.full(len(text.unique), -1)
                np.minimum.at(low, text.which, text.doc)
                np.maximum.at(high, text.which, text.doc)
                rows = [(b, name, text.unique[p].astype(np.uint32).tobytes(), np.packbits(low[p] < high[p]).tobytes())
                        for b, p in text.parts(buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows) if rows else ((), (), (), ()), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["bucket", "pack", "anchors", "several"])

    return packs.mapInArrow(run, "bucket int, pack long, anchors binary, several binary")


def _shared(anchors: DataFrame, hot_packs: int) -> DataFrame:
    """(pack, bucket, flags): per anchor of the pack 0, 1 if two documents have it, 2 if very many packs do."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(v, np.uint32) for v in table["anchors"].to_pylist()]
        sizes = [len(v) for v in lists]
        both = np.concatenate(lists)
        several = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=n) for v, n in zip(table["several"].to_pylist(), sizes)])
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        weight = np.bincount(which, several)
        flag = (((count + weight) > 1).astype(np.uint8) + (count > hot_packs))[which]
        out = [(p, b, zstandard.compress(f.tobytes(), 1)) for p, b, f in zip(
            table["pack"].to_pylist(), table["bucket"].to_pylist(), np.split(flag, np.cumsum(sizes)[:-1])) if f.any()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int32(), pa.binary()))],
                        names=["pack", "bucket", "flags"])

    return anchors.groupBy("bucket").applyInArrow(run, "pack long, bucket int, flags binary")


# -- contexts ----------------------------------------------------------------------

class Contexts:
    """The contexts a pack sends: in document order, and distinct ones with the smallest doc_id."""

    def __init__(self, text: Pack, flags: list[dict], buckets: int):
        flag = np.zeros(len(text.unique), np.uint8)
        given = {f["bucket"]: f["flags"] for f in flags}
        for b, places in text.parts(buckets):
            if b in given:
                flag[places] = np.frombuffer(zstandard.decompress(given[b]), np.uint8)
        kind = flag[text.which]
        plain, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        # Strings of hot anchors are contexts of their own.
        count = (text.end - text.begin - LENGTH + 1)[hot]
        at = np.repeat(text.begin[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.begin = np.concatenate((text.begin[plain], at)).astype(np.int64)
        self.end = np.concatenate((text.end[plain], at + LENGTH)).astype(np.int64)
        self.doc = np.concatenate((text.doc[plain], np.repeat(text.doc[hot], count))).astype(np.int64)
        h = _stretches(text.text, self.begin, self.end)
        self.unique, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.first = first
        gram = np.concatenate((text.gram[plain], h[len(plain):]))[first]
        self.gram = gram
        self.least = np.full(len(first), _NULL_ID, np.int64)
        np.minimum.at(self.least, self.which, text.ids[self.doc])

    def parts(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        shard = (self.gram >> np.uint64(16)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for places in np.split(order, cut) if len(order) else ():
            yield int(shard[places[0]]), places


def _send(joined: DataFrame, buckets: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name, text, row in _of(batch):
                own = Contexts(text, row["flags"] or [], buckets)
                rows = []
                for s, p in own.parts(shards):
                    begin, end = own.begin[own.first[p]], own.end[own.first[p]]
                    size = end - begin
                    take = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    rows.append((s, name, len(p), squeeze.compress(size.astype(np.uint8).tobytes() + own.least[p].tobytes()
                                                                   + own.gram[p].astype(np.uint32).tobytes() + text.text[take].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows) if rows else ((), (), (), ()), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                    names=["shard", "pack", "n", "contexts"])

    return joined.mapInArrow(run, "shard int, pack long, n int, contexts binary")


# -- the enhanced suffix array of a shard --------------------------------------------

def suffix_array(text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LENGTH):
    """(context, place, common prefix with the one before) of all suffixes of at least ``least`` bytes, sorted.

    Contexts are ``text[begin:end]``; common prefixes stop at a context's end.
    """
    count = np.maximum(end - begin - least + 1, 0)
    which = np.repeat(np.arange(len(begin)), count)
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    left = end[which] - at
    if not len(at):
        return which, at, np.empty(0, np.int64)
    words = -(-int(left.max()) // 8)
    padded = np.concatenate((text, np.zeros(8 * words, np.uint8)))
    key = np.zeros((words, len(at)), np.uint64)
    for w in range(words):
        for j in range(8):
            byte = np.where(left > 8 * w + j, padded[at + 8 * w + j], 0).astype(np.uint64)
            key[w] |= byte << np.uint64(56 - 8 * j)
    order = np.lexsort(key[::-1])
    key, which, at, left = key[:, order], which[order], at[order], left[order]
    common = np.zeros(len(at), np.int64)
    same = np.ones(len(at) - 1, bool)
    for w in range(words):
        differ = key[w, 1:] ^ key[w, :-1]
        equal = np.full(len(differ), 8)
        for j in range(8):
            equal = np.minimum(equal, np.where(differ >> np.uint64(56 - 8 * j) & np.uint64(255) != 0, j, 8))
        common[1:] += np.where(same, equal, 0)
        same &= equal == 8
    common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))
    return which, at, common


def intervals(common: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(depth, first, past) of all common-prefix intervals of at least ``least``, by one scan with a stack."""
    stack: list[list[int]] = []
    for i, c in enumerate([*common[1:].tolist(), 0], start=1):
        first = i - 1
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            yield depth, first, i
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append([c, first])


def maximal_groups(text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LENGTH):
    """The maximal repeats of a set of contexts: (depth, contexts, places) with all occurrences of each.

    An interval is kept if its suffixes follow different bytes, or one starts its context.
    """
    which, at, common = suffix_array(text, begin, end, least)
    if not len(at):
        return
    before = np.where(at > begin[which], text[at - 1].astype(np.int64), -1 - np.arange(len(at)))
    turns = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    for depth, a, b in intervals(common, least):
        if turns[b - 1] != turns[a]:
            yield depth, which[a:b], at[a:b]


def _judge(contexts: DataFrame) -> DataFrame:
    """(pack, shard, cover): two bytes per context of the pack: what of it is not the pack's smallest doc_id's own.

    (0, 255): all of it occurs in a smaller doc_id. Otherwise the bytes from the first to before the second do.
    """

    def run(table: pa.Table) -> pa.Table:
        n = np.array(table["n"].to_pylist())
        sizes, leasts, grams, texts, hashes = [], [], [], [], []
        for k, packed in zip(n.tolist(), table["contexts"]):
            v = zstandard.decompress(packed.as_py())
            sizes.append(np.frombuffer(v, np.uint8, k).astype(np.int64))
            leasts.append(np.frombuffer(v, np.int64, k, k))
            grams.append(np.frombuffer(v, np.uint32, k, 9 * k))
            texts.append(np.frombuffer(v, np.uint8, offset=13 * k))
            past = np.cumsum(sizes[-1])
            hashes.append(_stretches(texts[-1], past - sizes[-1], past))
        size, least, gram, text, h = map(np.concatenate, (sizes, leasts, grams, texts, hashes))
        del sizes, leasts, grams, texts, hashes
        end = np.cumsum(size)
        begin = end - size
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        owner = np.full(len(first), _NULL_ID, np.int64)
        np.minimum.at(owner, which, least)
        # Contexts that are alone with their anchor share nothing but themselves.
        _, group, members = np.unique(gram[first], return_inverse=True, return_counts=True)
        some = np.flatnonzero(members[group] > 1)
        cover = np.zeros((len(first), 2), np.int64)
        place = first[some]
        for depth, ctx, at in maximal_groups(text, begin[place], end[place]):
            of = owner[some[ctx]]
            smallest = of.min()
            for c, a in zip(ctx[of > smallest].tolist(), at[of > smallest].tolist()):
                c, a = some[c], a - begin[place[c]]
                lo, hi = cover[c]
                cover[c] = (a, a + depth) if hi == 0 else (min(lo, a), max(hi, a + depth))
        out = cover[which].astype(np.uint8)
        out[least > owner[which]] = (0, 255)
        parts = np.split(out, np.cumsum(n)[:-1])
        return pa.table([table["pack"], table["shard"], pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                        names=["pack", "shard", "cover"])

    return contexts.groupBy("shard").applyInArrow(run, "pack long, shard int, cover binary")


def _cut(joined: DataFrame, buckets: int, shards: int, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text, row in _of(batch):
                delta = np.zeros(len(text.text) + 1, np.int32)
                if row["covers"]:
                    own = Contexts(text, row["flags"] or [], buckets)
                    given = {c["shard"]: c["cover"] for c in row["covers"]}
                    cover = np.zeros((len(own.unique), 2), np.int64)
                    for s, p in own.parts(shards):
                        cover[p] = np.frombuffer(zstandard.decompress(given[s]), np.uint8).reshape(-1, 2)
                    first, past = cover[own.which].T
                    # The smallest doc_id of the pack keeps what is its own; any other loses the whole context.
                    whole = (past == 255) | (text.ids[own.doc] > own.least[own.which])
                    a = own.begin + np.where(whole, 0, first)
                    b = np.where(whole, own.end, own.begin + past)
                    np.add.at(delta, a, 1)
                    np.add.at(delta, b, -1)
                gone = np.cumsum(delta[:-1]) > 0
                out, start = [], 0
                for i, end in zip(row["ids"], text.ends.tolist()):
                    mask, piece = gone[start:end], text.text[start:end]
                    kept = piece[~mask].tobytes()
                    spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    out.append((i, end - start, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, keep_text: bool = True, pack_bytes: int = PACK_BYTES, bucket_bytes: int = BUCKET_BYTES,
          shard_bytes: int = SHARD_BYTES, hot_packs: int = HOT_PACKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document.

    A byte goes if a string of ``LENGTH`` bytes over it also starts in a document
    with a smaller doc_id. Null ids come last, and equal ids never remove each
    other; null and short texts keep everything.
    """
    packs = materialize(pack(docs, pack_bytes), "packs")
    total = packs.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()[0]
    buckets, shards = parts_for(int(total), bucket_bytes), parts_for(int(total), shard_bytes)
    flags = _shared(_anchors(packs, buckets), hot_packs).groupBy("pack").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    flags = materialize(flags, "repeat_flags")
    likely = packs.join(flags, "pack")  # packs without a shared anchor send nothing
    covers = _judge(_send(likely, buckets, shards)).groupBy("pack").agg(F.collect_list(F.struct("shard", "cover")).alias("covers"))
    covers = materialize(covers, "repeat_covers")
    return _cut(packs.join(flags.join(covers, "pack"), "pack", "left"), buckets, shards, keep_text)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs, keep_text=False).drop("kept")
