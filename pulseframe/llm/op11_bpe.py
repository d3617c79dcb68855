"""BPE encoding and decoding of whole texts by tree concatenation.

Short texts are encoded as they are. A long text is cut into leaves, which are
encoded in parallel, whichever document they come from; neighbouring nodes are then
joined, level by level, until one node is left. A cut may fall anywhere in a word,
so the tokens beside it can be wrong. A join encodes a window of the text around the
cut again, from a token's start in the left node to a token's start in the right one,
and doubles it until it agrees with both nodes: it has a token of the left node, and
after it one of the right node, at their own places. What the window says between the
two replaces the nodes' tokens there.

Why this is exact: merges choose the pair of lowest rank, the leftmost of equal ones.
Take texts ``A x B`` and ``C x D`` with a token ``x`` in both. In ``A x D`` the first
merge across the right border of ``x`` would meet the same symbols as in ``C x D``, where
it did not happen, and one across the left border the same as in ``A x B``; so
``A x D`` keeps the tokens of both. Tokens carry the end of their word, so equal tokens
at one place end, or go on with, the same piece of the splitting pattern; ``MARGIN`` keeps them away
from the ends of what was encoded, further than the pattern looks ahead. Leaves start at
characters that never compose with what precedes them, and never inside an added token.

Where a tokenizer drops white space, a text's tokens are those of its words, so each distinct word
of some texts is encoded once. Nodes travel compressed, with the window starts of their first and last
``EDGE`` tokens; a window that needs more of a node takes all of it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from pulseframe.llm.common import drop_columns, free_name, materialize, text_of

#: Code points of a leaf; texts up to this length are encoded at once.
LEAF = 16_384
#: Nodes that one task joins per level.
FAN = 16
#: Tokens on either side of a cut in the first window, and bytes that an agreeing token keeps from its ends.
WINDOW, MARGIN = 24, 16
#: Characters that start a new composition whatever stands before them: ASCII, Latin, Greek and Cyrillic
#: letters, ideographs and Hangul syllables.
FRESH = re.compile("[\x00-\u02FF\u0370-\u0482\u048A-\u052F\u3400-\u9FFF\uAC00-\uD7A3]")
#: Words kept with their tokens, and the longest of them; tokens at a node's ends that may start a window.
WORDS, WORD_CHARS, EDGE = 600_000, 64, 512
_CODECS: dict[str, "Codec"] = {}


@dataclass
class Node:
    """A stretch of text, its tokens, and for each token where a window may start (-1: not there)."""

    text: str
    ids: np.ndarray
    cut: np.ndarray


class Codec:
    """A tokenizer of the ``tokenizers`` library, without truncation, padding and special tokens of its own."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # Symbols of byte-level tokens are bytes, so this is a token's length in normalised bytes.
        self.width = np.array([
            len(n) - len(suffix) if suffix and n.endswith(suffix) and n not in self.added else len(n) for n in names], np.int64)

        self.kept: dict[str, bytes] = {"": b""}
        raw = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = (all(not c.isspace() for a in self.added for c in a)
                        and raw(" don't\n stop  ") == raw("don't") + raw("stop") and raw("a b") == raw("a") + raw("b"))
        self.pack, self.unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        self.kind = np.dtype(np.uint16 if len(names) <= 1 << 16 else np.uint32)

    @classmethod
    def of(cls, spec: str) -> "Codec":
        if spec not in _CODECS:
            _CODECS.clear()
            _CODECS[spec] = cls(spec)
        return _CODECS[spec]

    def words(self, texts: list[str]) -> list[list[str]]:
        """The texts cut at blanks and line ends, if that changes no token."""
        return [t.replace("\n", " ").split(" ") for t in texts] if self.by_word else [[t] for t in texts]

    def learn(self, words: list[list[str]]) -> list[str]:
        """Put the words' tokens into ``kept``; returns the long ones, which are not to stay there."""
        if len(self.kept) > WORDS:
            self.kept = {"": b""}
        new = list(set().union(*words).difference(self.kept))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.kept[w] = array(self.kind.char, e.ids).tobytes()
        return [w for w in new if len(w) > WORD_CHARS]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        words = self.words(texts)
        long = self.learn(words)
        out = [np.frombuffer(b"".join(map(self.kept.__getitem__, w)), self.kind) for w in words]
        for w in long:
            del self.kept[w]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)

    def node(self, text: str) -> Node:
        words, = self.words([text])
        self.learn([[w for w in words if len(w) <= WORD_CHARS]])
        get, inside = self.kept.get, {}
        parts = [get(w, b"") if len(w) <= WORD_CHARS else b"" for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > WORD_CHARS).tolist():  # a long word may be entered in its middle
            found = self.tokenizer.encode(words[k], add_special_tokens=False)
            parts[k], inside[k] = array(self.kind.char, found.ids).tobytes(), found.offsets
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(parts), self.kind).astype(np.int32)
        token, char = np.cumsum(counts) - counts, np.cumsum(sizes + 1) - sizes - 1
        cut = np.full(len(ids), -1, np.int64)
        # Window starts are wanted near the ends only.
        for k in np.flatnonzero((counts > 0) & ((token < EDGE) | (token + counts > len(ids) - EDGE))).tolist():
            w, at, begin = words[k], int(token[k]), int(char[k])
            if k not in inside:
                cut[at] = begin if FRESH.match(w) else -1
                continue
            spans = np.array(inside[k], np.int64)
            apart = np.concatenate(([True], spans[1:, 0] >= np.maximum.accumulate(spans[:, 1])[:-1]))
            cut[at:at + len(spans)] = [begin + c if ok and FRESH.match(w, c) else -1 for c, ok in zip(spans[:, 0].tolist(), apart)]
        cut[:1] = 0
        return Node(text, ids, cut)

    def packed(self, node: Node) -> tuple[bytes, bytes, bytes]:
        head = min(len(node.cut), 2 * EDGE)
        ends = np.concatenate([node.cut[:head // 2], node.cut[len(node.cut) - (head - head // 2):]])
        return (self.pack(node.text.encode()), self.pack(node.ids.astype(self.kind).tobytes()), self.pack(ends.tobytes()))

    def unpacked(self, text: bytes, ids: bytes, ends: bytes) -> Node:
        numbers, ends = self.numbers(ids), np.frombuffer(self.unpack(ends), np.int64)
        cut = np.full(len(numbers), -1, np.int64)
        cut[:len(ends) // 2] = ends[:len(ends) // 2]
        cut[len(cut) - (len(ends) - len(ends) // 2):] = ends[len(ends) // 2:]
        return Node(self.unpack(text).decode(), numbers, cut)

    def numbers(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack(ids), self.kind).astype(np.int32)

    def cuts(self, text: str, leaf: int = LEAF) -> list[int]:
        """Starts of the leaves of about ``leaf`` characters, or fewer where nothing allows a cut."""
        pieces = -(-len(text) // leaf) if leaf else 1
        out = [0]
        for k in range(1, pieces):
            found = FRESH.search(text, max(k * len(text) // pieces, out[-1] + 1))
            if not found:
                break
            at = found.start()
            for name in self.added:  # not inside an added token
                inside = text.find(name, max(at - len(name) + 1, 0), at + len(name) - 1)
                at = inside if 0 <= inside < at else at
            if at > out[-1]:
                out.append(at)
        return out

    def join(self, a: Node, b: Node, window: int = WINDOW) -> Node:
        while True:
            i, j = max(len(a.ids) - window, 0), window
            while i and a.cut[i] < 0:
                i -= 1
            while j < len(b.ids) and b.cut[j] < 0:
                j += 1
            begin = int(a.cut[i]) if i else 0
            new = self.node(a.text[begin:] + (b.text[:int(b.cut[j])] if j < len(b.ids) else b.text))
            left, right = self._starts(a.ids[i:]), self._starts(b.ids[:j])
            places = self._starts(new.ids)
            border = left[-1]
            right += border
            # An agreeing token of the left node, the last; one of the right node, the first.
            p, at_p = self._agree(a.ids[i:], left, new.ids, places, border - MARGIN) if i else ([0], [0])
            q, at_q = (self._agree(b.ids[:j], right, new.ids, places, places[-1] - MARGIN)
                       if j < len(b.ids) else ([j], [len(new.ids)]))
            if len(p) and len(q):
                keep_a, keep_b = i + int(p[-1]) if i else 0, int(q[0])
                start, stop = int(at_p[-1]), int(at_q[0])
                moved = lambda cut, by: np.where(cut < 0, -1, cut + by)
                return Node(a.text + b.text, np.concatenate([a.ids[:keep_a], new.ids[start:stop], b.ids[keep_b:]]), np.concatenate([
                    a.cut[:keep_a], moved(new.cut[start:stop], begin), moved(b.cut[keep_b:], len(a.text))]))
            window *= 2

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        """Places of the tokens in normalised bytes, and the end of the last."""
        return np.concatenate(([0], np.cumsum(self.width[ids])))

    @staticmethod
    def _agree(ids, places, new_ids, new_places, limit) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens that both sequences have at one place, ending at ``limit`` at most."""
        _, k, n = np.intersect1d(places[:-1], new_places[:-1], return_indices=True)
        same = (ids[k] == new_ids[n]) & (places[k + 1] <= limit)
        return k[same], n[same]

    def fold(self, nodes: list[Node]) -> Node:
        """The nodes, which follow each other, joined in pairs."""
        while len(nodes) > 1:
            nodes = [self.join(nodes[k], nodes[k + 1]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))


# -- tables ----------------------------------------------------------------------

_NODE = pa.schema([("key", pa.string()), ("node", pa.int64()), ("nodes", pa.int64()),
                   ("text", pa.binary()), ("ids", pa.binary()), ("ends", pa.binary())])
_NODE_DDL = "key string, node long, nodes long, text binary, ids binary, ends binary"


def _leaves(texts: DataFrame, shared, leaf: int) -> DataFrame:
    """(key, node, nodes, text): the leaves of ``texts(key, text)``, compressed, those of equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                at = codec.cuts(text, leaf)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(at)), pa.array(range(len(at)), pa.int64()), pa.array([len(at)] * len(at), pa.int64()),
                    pa.array([codec.pack(text[s:e].encode()) for s, e in zip(at, [*at[1:], len(text)])], pa.binary())],
                    names=["key", "node", "nodes", "text"])

    # The shuffle that drops copies also spreads the leaves of one text.
    return texts.mapInArrow(run, "key string, node long, nodes long, text binary").dropDuplicates(["key", "node"])


def _encode_leaves(leaves: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                key, node, nodes, text = (c[k].as_py() for c in batch.columns)
                done = codec.packed(codec.node(codec.unpack(text).decode()))
                yield pa.RecordBatch.from_pylist([dict(zip(_NODE.names, (key, node, nodes, *done)))], schema=_NODE)

    return leaves.mapInArrow(run, _NODE_DDL)


def _join_level(nodes: DataFrame, shared, fan: int) -> DataFrame:
    """Every ``fan`` neighbouring nodes of a text become one; the last one of a text goes on without the text."""

    def run(table: pa.Table) -> pa.Table:
        codec, rows = Codec.of(shared.value), sorted(table.to_pylist(), key=lambda r: r["node"])
        done = codec.packed(codec.fold([codec.unpacked(r["text"], r["ids"], r["ends"]) for r in rows]))
        left = -(-rows[0]["nodes"] // fan)
        if left == 1:
            done = (None, done[1], None)
        return pa.Table.from_pylist([dict(zip(_NODE.names, (rows[0]["key"], rows[0]["node"] // fan, left, *done)))], schema=_NODE)

    return nodes.groupBy("key", F.expr(f"node div {fan}")).applyInArrow(run, _NODE_DDL)


def _long_ids(texts: DataFrame, shared, leaf: int, fan: int) -> DataFrame:
    """(key, packed) of long texts, by rounds of joins; each round is a written table."""
    nodes, done = _encode_leaves(_leaves(texts, shared, leaf), shared), []
    while True:
        nodes = materialize(_join_level(nodes, shared, fan), "bpe")
        done.append(nodes.where("nodes = 1").select("key", F.col("ids").alias("packed")))
        nodes = nodes.where("nodes > 1")
        if nodes.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _unpack(rows: DataFrame, packed: str, shared, decoded: bool) -> DataFrame:
    """``rows`` with ``ids`` for their packed column, and the decoded text if wanted."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    kept = [f for f in rows.schema.fields if f.name != packed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                names = row.schema.names
                ids = codec.numbers(row.column(names.index(packed))[0].as_py())
                more = [_lists([ids])] + ([pa.array(codec.decode([ids]), pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(
                    [*[row.column(names.index(f.name)) for f in kept], *more], names=[f.name for f in [*kept, *added]])

    return rows.mapInArrow(run, T.StructType(kept + added))


def _split(docs: DataFrame, path: str, leaf: int, fan: int):
    """The broadcast tokenizer, short and long documents, (key, packed tokens) of long texts, and those two names."""
    with open(path, encoding="utf-8") as f:  # a vocabulary file: a few MB, whatever the input
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    is_long = F.length(text_of(docs)) > leaf
    sha = F.sha2(text_of(docs).cast("binary"), 256)
    key, packed = free_name(docs, "_bpe_key"), free_name(docs, "_bpe_ids")
    long = docs.where(is_long)
    ids = _long_ids(long.select(sha.alias("key"), text_of(docs).alias("text")), shared, leaf, fan)
    return shared, docs.where(~is_long), long.withColumn(key, sha), ids.toDF(key, packed), key, packed


def _encode_short(docs: DataFrame, shared, decoded: bool) -> DataFrame:
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = codec.ids([t or "" for t in texts.slice(first, 256).to_pylist()])
                more = [_lists(ids)] + ([pa.array(codec.decode(ids), pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def encode(docs: DataFrame, path: str, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``docs`` with ``ids``, the tokens of the whole text under the tokenizer file ``path``.

    A null or empty text, or one of blanks, has no tokens. Repeated rows stay, equal texts have
    equal tokens; long ones are encoded once. A column named ``ids`` is replaced, all others
    stay, whatever their names. An empty table gives an empty one.
    """
    docs = drop_columns(docs, {"ids"})
    shared, short, long, ids, key, packed = _split(docs, path, leaf, fan)
    whole = _unpack(long.join(ids, key).drop(key), packed, shared, False)
    return _encode_short(short, shared, False).unionByName(whole)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; special tokens stay in. Null ids are none."""
    encoded = drop_columns(encoded, {"decoded"})
    with open(path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = [np.array(v or [], np.int64) for v in part.column(part.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(ids), pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def _digests(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def report(docs: DataFrame, path: str, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Number of tokens, and digests of the tokens and of the decoded text, of each document.

    Digests of long texts are taken once per text, before they meet its documents.
    """
    docs = docs.select(docs["doc_id"], docs["text"])
    shared, short, long, ids, key, packed = _split(docs, path, leaf, fan)
    whole = long.select("doc_id", key).join(_digests(_unpack(ids, packed, shared, True), key), key).drop(key)
    return _digests(_encode_short(short, shared, True), "doc_id").unionByName(whole)
