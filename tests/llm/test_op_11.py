"""Tree concatenation against the library's encoding of whole texts."""

import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pulseframe.llm import op11_bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CODEC = op11_bpe.Codec(open(PATH, encoding="utf-8").read())
PARTS = ["the", "'re", "'ll", "'", "--'", "ready", " ", "\n\t ", "1234", "aaaa", "abab", "é", "é", "ậ", "İ", "ß", "Σ", "각",
         "日本", "ぁぁ", "한국", "🙂👩‍🔬", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "</w>", "internationalisation", "ХАХА", " ", "\x00", "'s's", "!!??"]


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def by_tree(text, leaf, window):
    at = CODEC.cuts(text, leaf)
    nodes = [CODEC.unpacked(*CODEC.packed(CODEC.node(text[s:e]))) for s, e in zip(at, [*at[1:], len(text)])]
    while len(nodes) > 1:
        nodes = [CODEC.join(*nodes[k:k + 2], window) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    assert nodes[0].text == text
    return nodes[0].ids.tolist(), len(at)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.integers(1, 40), st.integers(1, 12))
def test_any_cut_gives_the_whole_encoding(parts, leaf, window):
    text = "".join(parts)
    assert by_tree(text, leaf, window)[0] == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abint her's<|>éΣ"), max_size=300), st.integers(1, 60))
def test_unsplit_words(text, leaf):
    assert by_tree(text, leaf, 2)[0] == whole(text)


def test_long_runs():
    rng = random.Random(3)
    for text in ("a" * 20_000, "ab" * 9_001, "".join(rng.choice("abcdehinrst") for _ in range(30_000)), " " * 5_000, "́" * 3_000, "日" * 5_000, "1" * 4_000 + "x"):
        got, leaves = by_tree(text, 700, 8)
        assert got == whole(text) and (leaves > 1 or text[0] == "́")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30), max_size=5))
def test_words_give_the_whole_encoding(texts):
    texts = ["".join(t) for t in texts]
    assert CODEC.by_word and [i.tolist() for i in CODEC.ids(texts)] == [whole(t) for t in texts]


def test_a_tokenizer_that_keeps_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, library = op11_bpe.Codec(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = ["a b", "  two  blanks\n\n here ", "word" * 60]
    assert not codec.by_word and [i.tolist() for i in codec.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_leaf_starts_with_a_character_that_composes():
    second = set()
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    for c in map(chr, range(0xD800)):
        if op11_bpe.FRESH.match(c):
            first = unicodedata.normalize("NFD", c)[0]
            assert unicodedata.combining(first) == 0 and first not in second and not "ᅡ" <= first <= "ᇿ"


def digests(i, text):
    ids = whole(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(ids), sha(" ".join(map(str, ids))), sha(WHOLE.decode(ids, skip_special_tokens=False)))


def rows(frame):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame.collect()), key=repr)


def test_query_matches_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert rows(queries.QUERIES["op11_bpe_codec"](spark, folder)) == sorted((digests(r.doc_id, r.text) for r in docs), key=repr)


@pytest.mark.parametrize("leaf,fan", [(16_384, 16), (50, 2), (17, 3)])
def test_odd_tables(spark, leaf, fan):
    rng = random.Random(leaf)
    texts = [None, "", " \n", "x", "<|endoftext|>" * 9, "a" * 400, "".join(rng.choice(PARTS) for _ in range(400)), *["same long text " * 40] * 30, *["x" * 90 + " " + "é" * 70] * 2]
    docs = [(None if k % 9 == 4 else k // 2, t, "kept", -1) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, ids string, _bpe_key int")
    assert rows(op11_bpe.report(frame, PATH, leaf, fan)) == sorted((digests(d[0], d[1]) for d in docs), key=repr)
    got = op11_bpe.decode(op11_bpe.encode(frame, PATH, leaf, fan), PATH)
    assert got.columns == ["doc_id", "text", "_bpe_key", "ids", "decoded"]
    assert sorted((repr(r.text), list(r.ids)) for r in got.collect()) == sorted((repr(d[1]), whole(d[1])) for d in docs)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert op11_bpe.report(frame, PATH).count() == 0 and op11_bpe.encode(frame, PATH).columns == ["doc_id", "text", "ids"]
