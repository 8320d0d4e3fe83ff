"""Byte-level BPE, token files and counts, against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from screenlab.llm import bpe, chunks, counts, tokenfile
from screenlab.llm.queries import QUERIES, pattern, vocabulary

from .conftest import EDGE, SF

RANKS = "byte_bpe_multi_50k.tiktoken"
ALPHABET = "ab's 1. \n\té日本😀​\x85　\x1c ñ'llT  Z#*<|endoftext|>,;"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]
    return made + [bytes(rnd.choice(b"theaingoterns") for _ in range(rnd.randrange(1, 40))).decode() for _ in range(n)]


def test_transducer_equals_tiktoken(encoding):
    codec = bpe.codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    for text in odd_texts(3000) + [t or "" for _, t, _ in EDGE]:
        assert codec.encode(text) == encoding.encode_ordinary(text)


def test_transducer_with_few_states(encoding):
    small = bpe.Transducer(dict(encoding._mergeable_ranks), max_states=20, max_pairs=20)
    for text in odd_texts(300, 2):
        for piece in bpe.regex.findall(public_tokenizers.PATTERN, text):
            assert list(small.encode(piece.encode())) == encoding.encode_ordinary(piece)


def test_tokens_come_before_the_end(encoding):
    machine = bpe.Transducer(dict(encoding._mergeable_ranks))
    longest = max(map(len, encoding._mergeable_ranks))
    piece, out, first = (b"thing" * 40), [], None
    for i, tokens in enumerate(machine.stream(piece)):
        out += tokens
        first = i if tokens and first is None else first
    assert out == encoding.encode_ordinary(piece.decode()) and first <= longest


def test_decoder_streams_and_mends(encoding):
    codec = bpe.codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    for text in odd_texts(300, 3):
        ids = codec.encode(text)
        assert "".join(codec.decode(ids, 1)) == text
    rnd = random.Random(4)
    for _ in range(500):
        data = bytes(rnd.choice(b"a\x80\xc3\xa9\xf0\x9f\x98\x80\xed\xa0\xff") for _ in range(rnd.randrange(12)))
        decoder = bpe.StreamDecoder({i: bytes([b]) for i, b in enumerate(data)}, frozenset(range(256)))
        got = "".join(decoder.feed([i]) for i in range(len(data))) + decoder.close()
        assert got.replace("�", "") == data.decode(errors="replace").replace("�", "")


def test_bpe_query(spark, docs, encoding):
    for source, frame in ((docs, QUERIES["op7_bpe_roundtrip"](spark, SF)),):
        want = {r["doc_id"]: encoding.encode_ordinary(r["text"]) for r in source.collect()}
        rows = frame.collect()
        assert len(rows) == source.count()
        for r in rows:
            ids = want[r["doc_id"]]
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()


def test_other_patterns(encoding):
    """Cuts at spaces are for the public pattern alone: any other has each text whole."""
    own = r"[^\s]+ ?|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(RANKS), "rb"))}
    codes, want = bpe.Codec(ranks, own), tiktoken.Encoding("other", pat_str=own, mergeable_ranks=ranks, special_tokens={})
    assert not codes.cuts and bpe.Codec(ranks, pattern()).cuts
    for text in odd_texts(200, 9):
        assert codes.encode(text) == want.encode_ordinary(text)


def test_bpe_edge_cases(spark, edge, encoding):
    out = bpe.encode_texts(edge, vocabulary(RANKS), pattern(), ["doc_id", "score"], ["n_tokens", "token_ids", "decoded"], step=1000).collect()
    assert len(out) == len(EDGE)
    want = sorted((i or 0, len(encoding.encode_ordinary(t or "")), t or "") for i, t, _ in EDGE)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in out) == want and all(len(r["token_ids"]) == r["n_tokens"] for r in out)
    assert bpe.encode_texts(edge.limit(0), vocabulary(RANKS), pattern(), ["doc_id"], ["n_tokens"]).count() == 0


def test_windows_join(library):
    for text in odd_texts(300, 5):
        assert "".join(chunks.windows(text, 7)) == text and " ".join(chunks.parts(text)) == text


def test_library_encoder(library):
    codes = counts.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), parts_kept=50)
    assert codes.cuts and len(codes.table) == 243
    texts = odd_texts(1500, 6) + [t or "" for _, t, _ in EDGE]
    for start in range(0, len(texts), 100):
        for text, ids in zip(texts[start : start + 100], codes.encode(texts[start : start + 100])):
            assert list(ids) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("special", ["PADTOKEN", "<a.b>", "¶¶", ".end", "né"])
def test_special_strings(tmp_path, special):
    """Special strings of any make are found as the library finds them."""
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        kind = json.load(f)
    kind["added_tokens"].append({**kind["added_tokens"][0], "id": 50257, "content": special})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(kind), encoding="utf-8")
    codes, own = counts.LibraryEncoder(str(path)), Tokenizer.from_file(str(path))
    texts = [special, f"one {special} two", f"one{special}two {special}.", f" {special}{special} x", special * 2 + " end", "one two end."]
    texts += [t.replace("Z", special) for t in odd_texts(300, 8)]
    for batch in (texts, texts[::-1]):
        assert [list(x) for x in codes.encode(batch)] == [own.encode(t, add_special_tokens=False).ids for t in batch]
    assert codes.cuts == (special != ".end")


def test_count_query(spark, docs, edge, library):
    for source in (docs, edge):
        want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in source.collect())
        out = counts.count_tokens(source, vocabulary("byte_bpe_50k.json"), ["doc_id"], most_bytes=5000).collect()
        assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in out) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out)
    assert counts.count_tokens(edge.limit(0), vocabulary("byte_bpe_50k.json"), ["doc_id"]).count() == 0
    assert QUERIES["op10_token_counts"](spark, SF).count() == docs.count()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(edge, name):
    out = counts.count_tokens(edge, vocabulary(name), ["doc_id"]).collect()
    if name.endswith(".json"):
        model = Tokenizer.from_file(public_tokenizers.path(name))
        size = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = lambda t: len(model.encode(t))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == sorted((i or 0, size(t or "")) for i, t, _ in EDGE)


def test_token_file_reads_only_its_frames(tmp_path):
    rng = np.random.default_rng(1)
    made = [(i if i != 5 else None, rng.integers(0, 50_000, rng.integers(0, 400)).astype(np.uint32)) for i in range(60)]
    data = tokenfile.dumps(made, frame_bytes=2000)
    path = tmp_path / "a.ztok"
    path.write_bytes(data)
    got = tokenfile.read_documents(str(path), [3, 40])
    assert set(got) == {3, 40} and all((got[i] == made[i][1]).all() for i in got)
    with tokenfile.reader(str(path)) as f:
        tokens = tokenfile.TokenReader(f)
        seen, whole = [], tokens.frame
        tokens.frame = lambda k: seen.append(k) or whole(k)
        assert [np.frombuffer(d, "<u4").tolist() for _, d in tokens.documents([3])] == [made[3][1].tolist()] and len(seen) == 1
        assert all((np.frombuffer(d, "<u4") == made[i][1]).all() for i, d in tokens.documents())
    broken = bytearray(data)
    broken[30] ^= 255
    path.write_bytes(bytes(broken))
    with pytest.raises(Exception):
        tokenfile.read_documents(str(path), [0])


def test_token_file_query(spark, docs, edge, library):
    for source in (docs, edge):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in source.collect()))
        at, want = 0, []
        for _, i, t in rows:
            ids = [*library.encode(t, add_special_tokens=False).ids, 0]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        out = tokenfile.read_tokens(tokenfile.write_tokens(source, vocabulary("byte_bpe_50k.json"), most_bytes=5000)).collect()
        assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(want)
    # rows without an id are dealt by their texts
    lost = spark.createDataFrame([(None, f"{k % 7}{k} text") for k in range(400)], "doc_id long, text string")
    made = tokenfile.write_tokens(lost, vocabulary("byte_bpe_50k.json"), files=4).collect()
    assert len(made) >= 3 and sum(r["n_docs"] for r in made) == 400
    assert tokenfile.read_tokens(tokenfile.write_tokens(edge.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0
