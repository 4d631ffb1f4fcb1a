"""Every id in one piece, ids equal to the tokenizer's, no padding; odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitefit.llm.packing import Encoder, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(docs, tokenizer):
    ids = {}
    for r in docs.collect():
        found = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault(r["doc_id"], []).append(found)
    pieces = [r.asDict() for r in pack(docs, PATH).collect()]
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in ids.values() for x in xs)
    for doc_id, texts in ids.items():
        mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == doc_id)
        if len(texts) == 1:
            at = 0
            for start, length, crc in mine:
                assert start == at and crc == zlib.crc32(texts[0][start : start + length].tobytes())
                at += length
            assert at == len(texts[0]) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == doc_id)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == parts[0]["context_size"] <= 1024 and at & (at - 1) == 0
    return pieces


def test_given_documents(small, tokenizer):
    pieces = check(small[0].limit(120), tokenizer)
    groups = {}
    for p in pieces:
        groups.setdefault(p["step_group"], set()).add(p["context_size"])
    assert all(len(sizes) == 1 for sizes in groups.values())


def test_odd_rows(odd_docs, no_docs, tokenizer):
    check(odd_docs, tokenizer)
    assert pack(no_docs, PATH).count() == 0


def test_encoder_equals_tokenizer(tokenizer):
    encoder = Encoder(PATH)
    texts = ["a  b   c", " lead", "trail ", "a \n b", "x\n\n y", "  ", "don't it's  ok", "née “quoted” – dash… €5", "日本 語", "a\x0bb \x1c c", "🙂 ok", "12 345abc!!", "", "\n", "x" * 5000]
    assert [encoder.encode(t) for t in texts] == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
