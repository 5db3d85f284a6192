from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe, queries

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODEC = bpe.Codec(bpe.rules(PATH))
ODD = [
    "", " ", "  ", "\n", "don't we'll they've I'm he'd 's' ''s x!'s 're'r'rx  's \n's", "a\n\n b  \n", "  x", "  y  z",
    "\x1c\x1d a\x85b", "'", "' s", "it's1'd2", "日本語 テスト １２", "é ́", "😀😀 😀", "<|endoftext|>", " '", "a  ", "'llama 'l 'v",
    "x" * 3000, "ab" * 2000, " " * 3000, "é" * 999, "'s" * 500, "​ a", "a　b",
]


def test_odd_texts(truth):
    assert [x.tolist() for x in CODEC.encode(ODD)] == [truth.encode_ordinary(t) for t in ODD]
    for text in ODD:
        assert CODEC.decode(CODEC.encode([text])[0]) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1'strevldm \n\t !é日.") | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_random_texts(truth, texts):
    assert [x.tolist() for x in CODEC.encode(texts)] == [truth.encode_ordinary(t) for t in texts]


def test_every_code_point(truth):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c} {c}{c}1" for c in points[i : i + 2048]) for i in range(0, len(points), 2048)]
    assert [x.tolist() for x in CODEC.encode(texts)] == truth.encode_ordinary_batch(texts, num_threads=4)


def test_every_code_point_beside_each_class(truth):
    # short texts, so that one class that differs does not hide behind the merges around it
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["\n".join(f"a{c}a 1{c}1 .{c}. {c}?" for c in points[i : i + 1024]) for i in range(0, len(points), 1024)]
    assert [x.tolist() for x in CODEC.encode(texts)] == truth.encode_ordinary_batch(texts, num_threads=4)


def test_classes_without_the_library():
    own, python = bpe.own_classes(), bpe._python_classes()
    python[ord(" ")] = bpe.SPACE
    # a younger Unicode version only assigns code points that had no class
    differ = [i for i in (own != python).nonzero()[0].tolist() if bpe.unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    assert differ == []


def test_cuts_of_long_texts(truth, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", " ", "\n", "'s", "!", "é", "12"]) for _ in range(4000))
    want = truth.encode_ordinary(text)
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe.safe_pieces, "__defaults__", (50,))
    assert CODEC.encode([text, text])[1].tolist() == want


def test_query_against_library(spark, truth):
    got = {r.doc_id: r for r in queries.op8_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = truth.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert bpe.PATTERN == public.PATTERN
    at_once = bpe.encode(docs, PATH, decoded="decoded")
    assert sorted(bytes(r.decoded) for r in at_once.collect()) == [b"", b"", b"a b"] and at_once.columns == ["doc_id", "text", "ids", "ends", "decoded"]
    assert sorted(bytes(r.decoded) for r in got) == [b"", b"", b"a b"]
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_pieces_merged_side_by_side_equal_those_merged_alone():
    rng = random.Random(5)
    pieces = [bytes(rng.choices(b"aab t\xc3\xa9\x00\xff1", k=rng.randrange(1, 49))) for _ in range(5000)]
    pieces += ["".join(rng.choices(["sch", "ei", "ung", "é", "日"], k=rng.randrange(1, 9))).encode() for _ in range(5000)]
    pieces = [p for p in pieces if p not in CODEC.ranks]
    want = [bpe.merge(p, CODEC.ranks) for p in pieces]
    assert CODEC.pairs.merge(pieces) == want and CODEC.pairs.merge([]) == []
    assert CODEC.pairs.count(pieces).tolist() == [len(ids) for ids in want]
    assert CODEC._merged([b"the", b"x" * 100, *pieces]) == [bpe.merge(b"the", CODEC.ranks), bpe.merge(b"x" * 100, CODEC.ranks), *want]


def test_rank_file_without_all_bytes():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3}
    own = bpe.Codec(bpe.Rules(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items()), bpe.own_classes()))
    texts = ["ab" * n + "a" for n in range(200)]
    assert [x.tolist() for x in own.encode(texts)] == [[3] * (n // 2) + [2] * (n % 2) + [0] for n in range(200)]


def test_remembered_pre_tokens_stay_few():
    # a task of the token counts has three Python workers, each of which comes to keep as many
    codec = bpe.Codec(bpe.rules(PATH))
    for at in range(0, 600_000, 40_000):
        text = " ".join([f"{i:05x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(at, at + 40_000)])
        own = [n for _, counts, _ in codec.sizes([text]) for n in counts.tolist()]
        assert own == [len(ids) for _, ids, _ in codec.pieces([text]) for ids in ids]
    assert len(own) == 40_000 and len(codec.known) + len(codec.older) < 500_000 and len(codec.counted) + len(codec.counted_before) < 500_000
