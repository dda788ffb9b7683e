"""The methods of operators decide their results: ranks of doubled prefixes, compiled normalisers."""

import collections
import math
import random
import struct

import numpy as np
import pytest
import sentencepiece

from factorloom.llm import pieces, repeats
from factorloom.sources.shipping import ship

from .test_operators import documents


@pytest.fixture(scope="module", autouse=True)
def _workers(spark):
    ship(spark)


# --- 8 ------------------------------------------------------------------------------------------
def removed(texts: list[str]) -> list[int]:
    data = [t.encode() for t in texts]
    seen = collections.Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    found = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        found.append(int(gone.sum()))
    return found


def test_ranks_of_doubled_prefixes_decide(spark, monkeypatch):
    rng = random.Random(21)
    texts = []
    for _ in range(20):
        base = "".join(rng.choice("abcdefgh") for _ in range(900))
        at = rng.randrange(380, 520)
        texts += [base, base[:at] + "#" + base[at + 1 :]]
    found = lambda: [r.n_removed for r in repeats.without_repeats(documents(spark, texts), keep=False).orderBy("doc_id").collect()]
    assert found() == removed(texts)
    monkeypatch.setattr(repeats, "doubled", lambda ranks: ranks)
    assert found() != removed(texts)  # places that differ within 352 bytes are told apart by their ranks alone


def test_repeats_in_texts_over_several_segments(spark):
    rng = random.Random(22)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    shared, edge = draw(700), repeats.SEGMENT
    long = draw(edge - 350) + "#" + shared + "#" + draw(edge - 1000) + "%" + shared[100:] + "%" + draw(300)
    texts = [long, draw(200) + "+" + shared[:450] + "+" + draw(200), draw(500)]
    found = [r.n_removed for r in repeats.without_repeats(documents(spark, texts), keep=False).orderBy("doc_id").collect()]
    assert found == removed(texts) == [1300, 450, 0]


# --- 6 ------------------------------------------------------------------------------------------
def varint(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(parts) -> bytes:
    """A protocol buffer message of (number, value): integers, floats of four bytes as tuples, byte strings."""
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, tuple):
            out += varint(number << 3 | 5) + value[0]
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def changed_model(path, rule=None, squeeze=False, prefix=True, fallback=True, unigram=False, given=()):
    """The public model with another normaliser, without byte pieces, with unigram scores, with user-defined pieces."""
    parts = []
    for number, value in pieces.fields(open(pieces.model_path(), "rb").read()):
        if number == 1:
            piece = dict(pieces.fields(value))
            if piece.get(3) == 6 and not fallback:
                continue
            if piece[1].decode() in given:
                piece[3] = 4
            if unigram and piece.get(3, 1) == 1:  # ranks as logarithms of shares, which models of this kind hold
                piece[2] = struct.pack("<f", -6 - math.log1p(min(-struct.unpack("<f", piece[2])[0], 1e6)))
            value = message([(k, (v,) if k == 2 else v) for k, v in sorted(piece.items())])
        elif number == 2:
            trainer = dict(pieces.fields(value))
            trainer = {k: (v,) if k in (10, 15, 51) else v for k, v in trainer.items()} | {3: 1 if unigram else 2, 35: int(fallback)}
            value = message(sorted(trainer.items(), key=lambda t: t[0]))
        elif number == 3:
            rules = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())).get(2, b"") if rule else b""
            value = message([(1, (rule or "identity").encode()), (2, rules), (3, int(prefix)), (4, int(squeeze)), (5, 1)])
        parts.append((number, value))
    path.write_bytes(message(parts))
    return str(path)


ODD = ["", " ", "   ", "a", " a  b ", "Ｈｅｌｌｏ　　ﬁ ①  x", "été ¨ ½ ㌕ x", "\x01\x02", "\x07 a\x08b", "a\tb\r\nc\n\nd", "▁", "a▁ b▁▁", "ＡＢＣ ｶﾞ ﾊﾟ가", "​ x ﻿",
       "日本語 と 漢字", "🙂🙂 ok 🙂", "é\né🙂\n🙂", "the the <user> name<user><user>s", "́́", "ΑΒΓ ς Σ İ ẞ", "x" * 300 + " " * 40 + "ｘ" * 300]


@pytest.mark.parametrize("change", [
    {"rule": "nmt_nfkc", "squeeze": True}, {"rule": "nmt_nfkc_cf"}, {"rule": "nfkc", "prefix": False, "squeeze": True}, {"squeeze": True},
    {"fallback": False}, {"fallback": False, "rule": "nmt_nfkc", "squeeze": True}, {"given": ("▁the", "name", "er")},
    {"given": ("▁the", "name", "ﬁ"), "rule": "nfkc", "squeeze": True}, {"unigram": True, "rule": "nfkc"},
], ids=str)
def test_compiled_models_are_the_librarys(tmp_path, change):
    path = changed_model(tmp_path / "changed.model", **change)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
    rng = random.Random(6)
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + list("ﬀﬁﬂ①②㌀㍿豈更ﷺ🙂𝒜𝟘") + ["the", "name", " ", "er", "▁the"] * 40
    texts = ODD + ["".join(rng.choices(every, k=rng.randrange(1, 30))) for _ in range(3000)]
    total = lambda ids: sum(library.get_score(i) for i in ids)
    for text in texts:
        a, b = ours.encode(text).tolist(), library.encode(text)
        # sums of unigram scores tie within the library's single precision, as in runs of one character
        assert a == b or ("unigram" in change and library.decode(a) == library.decode(b) and abs(total(a) - total(b)) <= 1e-5 * abs(total(b))), text


def test_documents_through_a_normaliser(spark, tmp_path):
    path = changed_model(tmp_path / "changed.model", rule="nmt_nfkc", squeeze=True)
    found = pieces.encode_documents(documents(spark, [*ODD, None]), path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in found.collect()}
    texts = {r.doc_id: r.text for r in pieces.decode_documents(found.select("doc_id", "ids"), path).collect()}
    for i, text in enumerate([*ODD, ""]):
        assert rows[i].ids == library.encode(text) and rows[i].round_trip
        assert texts[i] == pieces.transducer(path).normalised(text)
