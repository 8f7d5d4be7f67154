"""Encoding, decoding and token files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from grantloom.llm import bpe, codes, pretokens
from grantloom.llm.common import scratch

RANKS = bpe.read_ranks(bpe.default_ranks())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
JSON = public_tokenizers.path("byte_bpe_50k.json")


def encoded(text):
    pieces, ends = pretokens.split([text.encode()])
    assert len(pieces) == ends[0] + 1
    return [i for piece in pieces[: ends[0]] for i in bpe.merge(piece, RANKS)]


def test_random_strings_match_the_library():
    draw = random.Random(3)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'s", " ", "\n", "\t", "1", "é", "!", "　", "中", "😀", "\x00", "\r\n", "\x85", "\x1c", "²", "m", "d"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        assert encoded(text) == LIBRARY.encode_ordinary(text), repr(text)


def test_classes_match_the_library_for_every_code_point():
    single = {bytes([i]): i for i in range(256)}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    classes = pretokens._tables()[0]
    for pattern, kind in ((r"\p{L}", pretokens.LETTER), (r"\p{N}", pretokens.NUMBER), (r"\s", pretokens.SPACE)):
        library = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        assert library.decode(library.encode_ordinary(text)) == "".join(chr(c) for c in points if classes[c] == kind)


def test_scan_equals_stepping():
    symbols = np.random.default_rng(1).integers(0, pretokens.SYMBOLS, 5000).astype(np.uint8)
    states = pretokens._scan(pretokens._tables()[2][symbols])
    state = pretokens.FREE
    for symbol, found in zip(symbols.tolist(), states.tolist(), strict=True):
        assert found == state
        state = pretokens._step(state, symbol)[0]


def test_long_pieces():
    draw = random.Random(1)
    for text in ("ab" * 20_000, "".join(draw.choice("abc") for _ in range(3000)), " " * 500 + "x"):
        assert encoded(text) == LIBRARY.encode_ordinary(text)


def test_cache_keeps_results_over_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    cache = bpe.PieceCache(lambda piece: list(piece))
    for _ in range(3):
        for piece in (b"a", b"b", b"cc", b"dd", b"e", b"x" * 100):
            assert np.frombuffer(cache[piece], "<i4").tolist() == list(piece)
    assert len(cache) <= 3


def test_query_on_odd_rows(spark, odd_docs, no_docs):
    path = bpe.default_ranks()
    rows = bpe.decode(bpe.encode(odd_docs, path), path).collect()
    texts = sorted((r["text"] or "") for r in odd_docs.collect())
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
    for r in rows:
        assert list(r["ids"]) == LIBRARY.encode_ordinary(bytes(r["decoded"]).decode())
        sizes = [len(LIBRARY.decode_bytes([i])) for i in r["ids"]]
        assert list(r["offsets"]) == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 500 else True
    assert bpe.decode(bpe.encode(no_docs, path), path).count() == 0


def test_op1_matches_the_library(spark, root, documents):
    found = {r["doc_id"]: r for r in bpe.op1_byte_bpe(spark, root).collect()}
    for r in documents.collect():
        text = r["text"] or ""
        ids = LIBRARY.encode_ordinary(text)
        expected = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(found.pop(r["doc_id"]))[1:] == expected
    assert not found


def test_codes_random_access():
    draw = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = (2 ** draw.uniform(0, 32, n)).astype(np.uint32)
        read = codes.Codes(codes.pack(ids))
        assert len(read) == n and read.all().tolist() == ids.tolist()
        for i in range(0, n, 3):
            assert read[i] == ids[i]


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(JSON)
    return [tokenizer.encode(text, add_special_tokens=False).ids + [0] for text in texts]


def test_op4_matches_the_library(spark, root, documents):
    found = {r["doc_id"]: r for r in codes.op4_token_files(spark, root).collect()}
    rows = sorted(documents.collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, ids in zip(rows, expected_ids([r["text"] or "" for r in rows]), strict=True):
        assert tuple(found[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_added_tokens_are_cut_out_first(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a <|endoftext|> b's<|endoftext", "<|endoftext|>\0\0 '<|endoftext|>ll", "\0"]
    folder = scratch(spark, "added")
    codes.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, JSON)
    rows = codes.read(spark, folder).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in rows] == expected_ids(texts)
    assert expected_ids(texts)[0] == [64, 50256, 65, 0]


def test_texts_beyond_a_segment(spark):
    texts = ["many words of one text " * 200_000, "x" * 3_000_000, "", "short", "é" * 700_000]
    folder = scratch(spark, "long")
    codes.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, JSON)
    rows = codes.digests(spark, folder).orderBy("doc_id").collect()
    expected = expected_ids([texts[0], "", "", "short", texts[4]])
    for i in (0, 2, 3, 4):
        assert (rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (len(expected[i]), zlib.crc32(np.array(expected[i], "<u4").tobytes()))
    assert rows[1]["n_tokens"] > 1


def test_files_of_odd_rows(spark, odd_docs, no_docs):
    folder = scratch(spark, "odd")
    codes.write(odd_docs, folder, JSON)
    rows = codes.read(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd_docs.collect()), key=lambda x: (x is not None, x))
    own = sorted(map(tuple, expected_ids([r["text"] or "" for r in odd_docs.collect()])))
    assert sorted(tuple(r["ids"]) for r in rows) == own
    flat = [i for r in rows for i in r["ids"]]
    places = [0, 1, len(flat) // 2, len(flat) - 1, len(flat) + 5]
    asked = spark.createDataFrame([(p,) for p in places], "position long")
    assert {r["position"]: r["id"] for r in codes.tokens_at(spark, folder, asked).collect()} == {p: flat[p] for p in places[:4]}
    empty = scratch(spark, "none")
    codes.write(no_docs, empty, JSON)
    assert codes.digests(spark, empty).count() == 0
