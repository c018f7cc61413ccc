"""Tokens against the libraries whose vocabularies are used."""

import base64
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm.bpe import RankQueueBPE
from stratagraph.llm.prefix_counts import PrefixCounter

ODD = ["", " ", "  ", "\n", "\n\n a", "a  b", "  a", "a ", "I'll we've 'S", "x\t\ty \n z", "你好 世界", "a\x1cb\x85c\xa0d", "▁a ▁▁ b", "<s> </s> <unk> <0x41>", "\x00", "é ́", "😀😀 ok", "a" * 700, "ab" * 900, " " * 300 + "x", "thereththe " * 50]


@pytest.fixture(scope="module")
def byte_bpe():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return RankQueueBPE.from_file(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    path = P.path("piece_bpe_32k.model")
    return PrefixCounter.from_sentencepiece(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_byte_bpe_odd(byte_bpe):
    ours, theirs = byte_bpe
    for t in ODD:
        assert list(ours.encode(t)) == theirs.encode_ordinary(t), t
        assert ours.decode(ours.encode(t)) == t.encode()


def test_queue_is_left_empty(byte_bpe):
    ours, _ = byte_bpe
    ours.encode_piece(random.Random(1).randbytes(5000))
    assert not any(ours.low)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_byte_bpe_any(byte_bpe, t):
    ours, theirs = byte_bpe
    assert list(ours.encode(t)) == theirs.encode_ordinary(t)


def test_piece_counts_odd(pieces):
    ours, theirs = pieces
    for t in ODD:
        assert ours.count(t) == len(theirs.encode(t)), t
        assert ours.prefixes(t)[-1] == ours.count(t)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="athern ▁<>sé你\n", max_size=30))
def test_every_prefix(pieces, t):
    ours, theirs = pieces
    assert list(ours.prefixes(t)) == [len(theirs.encode(t[:i])) for i in range(len(t) + 1)]


def test_cut(pieces):
    ours, theirs = pieces
    t = "the other thing than another " * 20
    for budget in (0, 1, 7, 50, 10**6):
        n = ours.cut(t, budget)
        assert len(theirs.encode(t[:n])) <= budget
        assert n == len(t) or all(len(theirs.encode(t[:m])) > budget for m in range(n + 1, len(t) + 1))


BROKEN = [(1, None, 5, "x"), (2, "", 6, None), (None, "a null id", 7, "y"), (None, None, 7, "y"), (3, "one text twice", 8, "z"), (3, "one text twice", 8, "z"), (4, "höher, weiter 你好 😀 " * 60_000, 9, "w")]


def broken(spark):
    """Null and empty texts, null and repeated ids, a text of over a megabyte, extra columns named like results."""
    return spark.createDataFrame(BROKEN, "doc_id long, text string, n_tokens int, ids_sha256 string")


def key(row):
    return tuple((x is not None, x) for x in row)


def test_round_trip_of_a_broken_table(spark, byte_bpe):
    from hashlib import sha256

    from stratagraph.llm import bpe

    want = []
    for i, text, *_ in BROKEN:
        ids = byte_bpe[1].encode_ordinary(text or "")
        want.append((i, len(ids), sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), sha256((text or "").encode()).hexdigest()))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.round_trip(broken(spark), path, P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    encoded = bpe.encode_documents(broken(spark), path, P.PATTERN).collect()
    assert sorted(((r.doc_id, len(r.ids) // 4) for r in encoded), key=key) == sorted((w[:2] for w in want), key=key)
    assert bpe.round_trip(broken(spark).where("false"), path, P.PATTERN).count() == 0


def test_counts_of_a_broken_table(spark, pieces):
    from stratagraph.llm import prefix_counts

    path = P.path("piece_bpe_32k.model")
    want = [(i, len((text or "").encode()), n := len(pieces[1].encode(text or "")), n > 4096) for i, text, *_ in BROKEN]
    got = prefix_counts.token_counts(broken(spark), path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert prefix_counts.token_counts(broken(spark).where("false"), path).count() == 0
