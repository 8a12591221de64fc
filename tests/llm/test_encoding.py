"""Byte-level BPE and token-id files against the public libraries, with edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from latencylab.llm import byte_bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
EDGES = [None, "", " ", "\n \nb", "a\n\n b", "it's  we'LL", "x" * 5000, "é ß 三 ー 😀\x1c\x85 st́", "<|endoftext|> a", "a b " * 20000]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, cache_entries=50)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=" \n\t  aBé'ß1²三!\x1c\x85#st́😀", max_size=24))
def test_ids_are_those_of_the_library(codec, library, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(codec):
    index = codec.index
    assert sorted(index.key_at) == list(range(len(codec.present)))
    assert all(index.candidate(k) == i for i, k in enumerate(codec.present))


def test_encoding_table_edges(spark, library):
    rows = [(i % 7, t, "clash", b"x") for i, t in enumerate(EDGES)] + [(None, "b", "c", b"y"), (None, "b", "c", b"y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, decoded binary")
    out = byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    expected = []
    for name, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        data = np.array(ids, "<u4").tobytes()
        expected.append((name, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    assert byte_bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(values=st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    coded = token_files.EliasFano.encode(np.array(values, np.uint64))
    assert coded.decode().tolist() == values == list(coded.values())
    assert all(len(b) <= token_files.SELECT_EVERY for b in coded.blocks())
    assert all(coded.select(i) == values[i] for i in range(0, len(values), 37))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20000)).astype(np.uint64)
    size = sum(map(len, token_files.EliasFano.encode(values).parts()))
    assert size * 8 / len(values) < 2.2 + np.log2(1000)


def test_word_encoder_by_chunks():
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    with open(WORDS, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read(), 2)
    rnd, alphabet = random.Random(3), " \n\t aBé'ß1²三!\x1c\x85#st́😀İΣ"
    texts = [t or "" for t in EDGES] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    for text, data in zip(texts, encoder(texts)):
        assert np.frombuffer(data, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("shard_ids", [40, 1 << 20])
def test_token_files_round_trip(spark, shard_ids):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rows = [(i * 3 - 4, t, 1) for i, t in enumerate(EDGES)] + [(7, "same", 1), (7, "same", 1), (7, "other", 1), (None, "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    out = token_files.read_files(token_files.write_files(docs, WORDS, end_id=2, shard_ids=shard_ids)).collect()
    at, expected = 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()) if r[0] == 7 else 0))
    for name, text, _ in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((name, at, len(ids)))
        at += len(ids)
    got = sorted(((r["id"], r["start"], r["n_tokens"]) for r in out), key=lambda r: r[1])
    assert [(g[0], g[2]) for g in got if g[0] != 7] == [(e[0], e[2]) for e in expected if e[0] != 7]
    assert [g[1] for g in got] == np.concatenate(([0], np.cumsum([g[2] for g in got])[:-1])).tolist()
    assert sum(g[2] for g in got) == at
    by_text = {len(library.encode(t, add_special_tokens=False).ids) + 1 for t in ("same", "other")}
    assert {g[2] for g in got if g[0] == 7} == by_text and sum(g[0] == 7 for g in got) == 3
    assert token_files.round_trip(docs.limit(0), WORDS, end_id=2).count() == 0


def test_shard_select_reads_one_document(spark):
    docs = spark.createDataFrame([(i, f"word {i} and more") for i in range(300)], "doc_id bigint, text string")
    manifest = token_files.write_files(docs.coalesce(1), WORDS, end_id=2).collect()
    for row in manifest:
        shard = token_files.Shard(row["path"])
        whole = list(shard.documents())
        assert all(shard.document(i).tolist() == ids.tolist() for i, (_, _, ids) in enumerate(whole))
        shard.close()


def test_word_encoder_with_small_memos(monkeypatch):
    """Chunks leave and re-enter both generations of the memo; ids stay those of the tokenizer."""
    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(token_files, "CHUNKS", 3)
    monkeypatch.setattr(token_files, "LEARN_AT_ONCE", 2)
    encoder, plain = token_files.WordEncoder(spec, 2), Tokenizer.from_str(spec)
    plain.encode_special_tokens = True
    texts = ["a b. a7 don't it' 7 7a x", "", "\u0130stanbul \u0130 \u00aa1 na\u00efve e\u0301t\u00e9 \u4e2d\u6587 \u00b2", "a b. c\x1cd", "ONE... two!! 'tis a"]
    for batch in (texts, texts[::-1], texts[:2]):
        got = [np.frombuffer(b, "<u2").tolist() for b in encoder(batch)]
        assert got == [plain.encode(t, add_special_tokens=False).ids + [2] for t in batch]
