import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import bpe


@pytest.fixture(scope="module")
def tools():
    own = bpe.Codec(P.path(bpe.VOCABULARY), P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_random_texts(tools, many):
    own, library = tools
    for x, (raw, back) in zip(many, own.encode(many), strict=True):
        assert ids(raw) == library.encode_ordinary(x) and back == x.encode() == own.decode(raw)


def test_long_words_and_small_queries(tools, monkeypatch):
    own, library = tools
    r = random.Random(3)
    words = ["".join(r.choice("abéßthein日本") for _ in range(n)) for n in (3, 40, 300, 480, 512, 513, 2000)] + ["a" * 700, "ab" * 450, "<|endoftext|>", "\n" * 50 + "x", "the" * 300, "aaab" * 200]
    for size, rows in ((1 << 18, 3_000_000), (50, 40), (1, 1)):
        monkeypatch.setattr(bpe, "QUERY_BYTES", size)
        monkeypatch.setattr(bpe, "QUERY_ROWS", rows)
        own.forget()
        some = words if rows > 1 else words[:2]
        for x, (raw, back) in zip(some, own.encode(some), strict=True):
            assert ids(raw) == library.encode_ordinary(x) and back == x.encode()


@pytest.mark.parametrize("signs", ["a", "the", "etaoin", "ACGT", "abcdefghijklmnopqrstuvwxyz", "日本語", "-=", " "])
def test_words_of_100_000_bytes(tools, signs):
    own, library = tools
    r = random.Random(4)
    many = [signs * (30_000 // len(signs.encode()))] + ([] if len(signs) == 3 else ["".join(r.choice(signs) for _ in range(100_000 // len(signs[0].encode())))])
    for x, (raw, back) in zip(many, own.encode(many), strict=True):
        assert ids(raw) == library.encode_ordinary(x) and back == x.encode()


def test_tables(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (3, "Hi there", b"x"), (3, "Hi there", b"x"), (None, "é", b"x")], "doc_id long, text string, ids binary")
    out = bpe.digest(bpe.encode(df)).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 1, 2, 2]
    assert bpe.encode(df.limit(0)).count() == 0
    assert {bytes(r.decoded) for r in bpe.encode(df).collect()} == {b"", b"Hi there", "é".encode()}


def test_decoded_bytes_come_from_the_ids(tools, monkeypatch):
    own, _ = tools
    real, letter = own._ids, own.ranks[b"?"].to_bytes(4, "little")
    monkeypatch.setattr(own, "_ids", lambda pieces: [(letter, b"?") for _ in real(pieces)])
    monkeypatch.setitem(own.bytes_of, own.ranks[b" the"], b"<the>")
    own.forget()
    (raw, back), = own.encode(["zqxjkvwq the"])
    own.forget()
    assert back == b"".join(own.bytes_of[i] for i in ids(raw)) and back.endswith(b"?<the>")


def test_words_and_pieces_of_the_last_texts_are_not_contracted_again(tools, monkeypatch):
    own, library = tools
    own.forget()
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1)
    asked, real = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda pieces: asked.extend(pieces) or real(pieces))
    for x in ("zqxjkvwq vrmblgrk", "vrmblgrk zqxjkvwq"):
        assert ids(own.encode([x])[0][0]) == library.encode_ordinary(x)
        assert len(asked) == len(set(asked)) > 0


def test_words_of_earlier_texts_are_not_parted_again(tools, monkeypatch):
    own, library = tools
    own.forget()
    asked, real = [], own._parts
    monkeypatch.setattr(own, "_parts", lambda words: asked.extend(words) or real(words))
    for x in ("zqxjkvwq", "vrmblgrk", "zqxjkvwq", "", "vrmblgrk zqxjkvwq"):
        assert ids(own.encode([x])[0][0]) == library.encode_ordinary(x)
    assert asked == [b"zqxjkvwq", b"vrmblgrk", b" zqxjkvwq"]


def test_results_do_not_depend_on_what_is_kept(tools, monkeypatch):
    own, library = tools
    own.forget()
    r = random.Random(5)
    words = ["".join(r.choice("abéßthein日本") for _ in range(r.randint(1, 12))) for _ in range(400)]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 40_000)
    for _ in range(12):
        many = [" ".join(r.choices(words, k=r.choice((0, 1, 50)))) for _ in range(5)]
        for x, (raw, back) in zip(many, own.encode(many), strict=True):
            assert ids(raw) == library.encode_ordinary(x) and back == x.encode() == own.decode(raw)
    assert len(own.words) < 300 < len(words)
    assert own.encode([]) == [] and own.encode(["", ""]) == [(b"", b"")] * 2
