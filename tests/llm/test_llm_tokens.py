"""Operators 1, 2 and 3: against the libraries themselves, and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domlens.llm import dac, pieces, transducer
from domlens.llm.queries import tokenizer

WORD, BYTE, PIECE = (tokenizer(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


# ---------------------------------------------------------------- 1
@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200), min_size=1, max_size=5))
def test_segment_gives_random_access(lists):
    ids = np.array([i for x in lists for i in x], np.uint32)
    segment = dac.Segment(dac.pack(ids, [None, *range(1, len(lists))], np.array([len(x) for x in lists])))
    assert segment.doc_ids == [None, *range(1, len(lists))]
    for k, x in enumerate(lists):
        assert segment.document(k).tolist() == x
    for at in range(0, len(ids), 37):
        assert segment[at] == ids[at]
    assert segment.read(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3:len(ids) // 2].tolist()
    with pytest.raises(IndexError):
        segment[len(ids)]


def test_word_encoder_is_the_library():
    random.seed(7)
    alphabet = ["a", "B", "é", "İ", "J̌", "ß", "Σ", "中", ".", ",", "'s", "'", "1", " ", " ", "\n", "\t", " ", "\u0085", "<|endoftext|>", "<|ENDOFTEXT|>", "x.", "word, ", "Word. ", "…"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 25))) for _ in range(1500)]
    encoder, plain = dac.WordEncoder(WORD), library(WORD)
    assert encoder.by_word and encoder.any_case
    for got, want in zip(encoder.encode([t.encode() for t in texts]), plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids
    whole = dac.WordEncoder(BYTE)  # white space counts there: whole texts
    assert not whole.by_word
    assert np.frombuffer(whole.encode([b"a b"])[0], "<u4").tolist() == library(BYTE).encode("a b").ids


def check_tokens(df, texts):
    plain = library(WORD)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["start"], r["n_tokens"], r["ids_crc32"]) for r in dac.tokens_roundtrip(df, WORD, 2).collect())
    want = sorted(((i is not None, i or 0), np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in texts) if len({i for i, _ in texts}) == len(texts) else None
    start = 0
    for key, at, n, _ in sorted(got, key=lambda x: (x[1], x[0])):
        assert at == start
        start += n
    assert [g[0] for g in sorted(got, key=lambda x: x[1])] == sorted(g[0] for g in got)
    if want:
        assert [(g[0], g[2], g[3]) for g in got] == [(k, len(ids), zlib.crc32(ids)) for k, ids in want]
    else:
        crc = sorted((len(x), zlib.crc32(x)) for x in (np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in texts))
        assert sorted((g[2], g[3]) for g in got) == crc


def test_token_files(corpus, docs, no_docs):
    check_tokens(corpus[0], [(i, t) for i, t, _ in corpus[1]])
    check_tokens(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert dac.tokens_roundtrip(no_docs, WORD, 2).collect() == []


# ---------------------------------------------------------------- 2
def test_transducer_is_the_library():
    random.seed(11)
    alphabet = [*"abé ß 中字  \n\t\x00 　😀'''srtveldm0123  .,!?ABC", "<|endoftext|>", "'re", "'s", "  ", "the", "ing", "tion", "\r\n"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 4000 + " x", "\n" * 2000 + "a", "é" * 3000, "<|endoftext|>" * 3, ""]
    machine, data = transducer.Transducer(BYTE), [t.encode() for t in texts]
    got = machine.count(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert got.tolist() == [len(e.ids) for e in library(BYTE).encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk,starts,states", [(16, 3, 60_000), (8, 2, 300), (64, 1, 60_000)])
def test_long_texts_and_small_tables(monkeypatch, chunk, starts, states):
    """Chains that leave the maps, chunks without safe cuts, and tables that are begun anew inside a text."""
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    monkeypatch.setattr(transducer, "STARTS", starts)
    monkeypatch.setattr(transducer, "MAX_STATES", states)
    random.seed(5)
    code = base64.b64encode(random.randbytes(6000)).decode()
    texts = ["a" * 3001, code, "x", code[::-1] + " tail", "ab" * 1500 + " x" * 40, "é中" * 700, "'s" * 500, "", "1" * 999 + "a" * 999 + "<|endoftext|>" + "b" * 700, "\n \n" * 400]
    machine, data = transducer.Transducer(BYTE), [t.encode() for t in texts]
    got = machine.count(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert got.tolist() == [len(e.ids) for e in library(BYTE).encode_batch_fast(texts, add_special_tokens=False)]
    assert len(machine.states) < states + 5000


def test_a_long_text_without_spaces():
    """Linear in the length: four times the text takes about four times as long."""
    random.seed(8)
    machine, took = transducer.Transducer(BYTE), []
    for size in (1, 4):
        text = "".join(random.choices("abcde", k=2000)) * (size * 250)
        data = np.frombuffer(text.encode(), np.uint8)
        machine.count(data, np.array([0, len(data)]))
        began = time.process_time()
        found = machine.count(data, np.array([0, len(data)]))
        took.append(time.process_time() - began)
        if size == 1:
            assert found.tolist() == [len(library(BYTE).encode(text, add_special_tokens=False).ids)]
    assert took[1] < 12 * took[0] + 1


def test_token_counts(docs, no_docs):
    plain = library(BYTE)
    got = transducer.token_counts(docs, BYTE, 1024).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(str, [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got])) == sorted(map(str, want))
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert transducer.token_counts(no_docs, BYTE, 1024).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        transducer.Transducer(WORD)


# ---------------------------------------------------------------- 3
def texts3():
    random.seed(3)
    return ["".join(random.choices([*"ab é ß 中文字 ▁ \n\t😀 's0123  ", "<s>", "  "], k=random.randint(0, 50))) for _ in range(800)] + ["", " ", "   "]


def test_pieces_are_the_library():
    codec, texts = pieces.PieceCodec(PIECE), texts3()
    for text, (ids, bounds), want in zip(texts, codec.encode([t.encode() for t in texts]), codec.library.encode(texts), strict=True):
        raw = text.encode()
        assert ids == want
        assert bounds[0] == 0 and bounds[-1] == len(raw) if ids else not raw
        for k, i in enumerate(ids):  # a piece's bytes are the text's, but for the marked space in front
            own, piece = raw[bounds[k]:bounds[k + 1]], codec.library.id_to_piece(i)
            if not codec.library.is_byte(i):
                assert own.replace(b" ", pieces.SPACE) in (piece.encode(), piece.encode()[3:])


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map(squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb
    with open(PIECE, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    rules = {"é": "e", "ab": "c", "a": "xy", "\t": " ", "中": "", "ß": "ss", "\n": " "}
    model.normalizer_spec.precompiled_charsmap = pieces.compile_map({k.encode(): v.encode() for k, v in rules.items()})
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    codec, texts = pieces.PieceCodec(model.SerializeToString()), texts3()
    for text, (ids, bounds), want in zip(texts, codec.encode([t.encode() for t in texts]), codec.library.encode(texts), strict=True):
        assert ids == want
        assert (np.diff(bounds) >= 0).all() and bounds[-1] <= len(text.encode())
    (ids, bounds), = codec.encode(["é ab".encode()])
    assert bounds[-1] == 5  # the end of the text, though its normal form is shorter


def test_encode_documents(docs, no_docs):
    codec = pieces.PieceCodec(PIECE)
    got = pieces.encode_documents(docs, PIECE, output="digests").collect()
    want = []
    for r in docs.collect():
        ids = codec.library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids).encode()).hexdigest(), len((r["text"] or "").encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = pieces.encode_documents(docs, PIECE).filter("doc_id = 7").first()
    assert whole["decoded"].startswith("é ß 中文") and whole["starts"][0] == 0 and len(whole["starts"]) == len(whole["ids"])
    assert pieces.encode_documents(docs, PIECE, output="ids").filter("doc_id = 4").first()["ids"] == []
    for output in ("pieces", "ids", "digests"):
        assert pieces.encode_documents(no_docs, PIECE, output=output).collect() == []
