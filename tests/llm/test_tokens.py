"""Token counts, the tree codec and packing against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe_tree, packing, token_counts

ODD = [
    "", "a", " ", "    ", "Σίσυφος ΟΔΟΣ", "<|endoftext|>hi <|startoftext|> x<|endoftext|>", "it's'S 'RE ՘Ɤ a", "x" * 5000, "ab" * 3000,
    "ẛ̣ é é \x1c\x1d a\x85b İI", "日本語 テスト 123 ４５", "a b  \n\n c", ("word" * 50 + " ") * 100, "\n \n a",
    "'" * 100 + "re " * 100, "😀" * 3000, "don't " * 2000, "a  " * 3000, "aaa aaaa aaaaa", "𐵐 Ᲊ",
]
SCHEMA = "doc_id long, text string, n_tokens int, ids string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


texts = st.text(st.one_of(st.sampled_from("ab '\n\tsrte<|>19é中ΣİK"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_counts_equal_the_library(word_library, text):
    want = len(word_library.encode(text, add_special_tokens=False).ids)
    assert token_counts.counter(P.path("word_bpe_49k.json")).counts([text]) == [want]


def test_token_counts_of_rows(spark, word_library):
    rows = [*ODD, None, ODD[4], ODD[4]]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, rows).repartition(3), P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(rows):
        n = len(word_library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(table(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_merges_out_of_order_are_refused():
    letters = token_counts.byte_letters().values()
    vocab = {x: i for i, x in enumerate([*letters, *(c + "</w>" for c in letters), "ab", "abc"])}
    with pytest.raises(ValueError, match="before"):
        token_counts.RankMerger(vocab, [["ab", "c"], ["a", "b"]], "</w>")


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 9), st.integers(1, 4))
def test_tree_codec_equals_the_library_and_round_trips(text, leaf, window):
    own = bpe_tree.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    own.leaf, own.window = leaf, window
    ids = own.encode(text)
    assert ids.tolist() == own.library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_codec_rows_and_digests(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [*ODD, None, ODD[3], ODD[3]]
    df = table(spark, rows).repartition(3)
    ids = bpe_tree.encode_texts(df, path)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe_tree.decode_ids(ids, path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(rows)}
    library = bpe_tree.TreeCodec(path).library
    for r in bpe_tree.encode_digests(df, path).collect():
        text = rows[r["doc_id"]] or ""
        want = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_tree.encode_digests(table(spark, []), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(texts)
def test_the_faster_library_gives_the_same_ids(byte_library, text):
    own = packing.encoder(P.path("byte_bpe_50k.json"))
    assert own.encode(text, allowed_special="all") == byte_library.encode(text, add_special_tokens=False).ids


def best_fill(counts, room):
    sums = {0}
    for n, k in enumerate(counts):
        for _ in range(k):
            sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 60))
def test_fill_is_the_best_subset_sum(lengths, room):
    counts = np.bincount(lengths, minlength=61) if lengths else np.zeros(61, dtype=int)
    taken = packing.fill(counts, sorted(set(lengths), reverse=True), room)
    assert sum(taken) == best_fill(counts, room)
    assert all(taken.count(n) <= counts[n] for n in set(taken))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_bins_hold_everything_without_gaps(lengths):
    bins, offsets = packing.minimum_bin_slack(np.array(lengths, dtype=np.int64), 32)
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, x in zip(offsets, lengths, bins, strict=True) if x == b)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) <= 32


def test_packing_of_rows(spark, byte_library):
    rows = [*ODD, None, *["same text " * 40] * 30, "long word " * 4000]
    got = packing.pack_documents(table(spark, rows).repartition(3), P.path("byte_bpe_50k.json")).toPandas()
    by_doc = {i: g.sort_values("piece") for i, g in got.groupby("doc_id")}
    for i, t in enumerate(rows):
        ids = np.array([*byte_library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = by_doc[i]
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert (own["length"].iloc[1:] == 2048).all() and own["length"].max() <= 2048
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 2048) + 1
    assert packing.pack_documents(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0
