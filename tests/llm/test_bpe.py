import hashlib
import random

import pytest
from tokenizers import Tokenizer

from flowsift.llm.bpe import Decoder, WordTransducer, decode_ids, digest_documents, encode_texts, encoder_of
from flowsift.llm.queries import vocabulary
from tests.llm.conftest import ODD_TEXTS

NAME = vocabulary("word_bpe_49k.json")

HARD = [
    "don't we'll 'sx ''s I'VE", "a  b\n\n c\t", "\x1c\x1d x\x85y\xa0z", "²³½ 12 Ⅷ", "“quoted”… — ok", "ª º ǅ ʰ Ⱥ Ɓ ſ",
    "x y z'RE", "﻿a ́b 　c", "é e", "!!!???...---", "<|endoftext|", "x<|endoftext|>y",
]


@pytest.fixture(scope="module")
def encoder():
    return encoder_of(NAME)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(NAME)


def encoded(encoder, text):
    return [i for part in encoder.encode(text) for i in part]


def test_texts_are_encoded_as_by_the_library(encoder, library, documents):
    for text in [*HARD, *[t for t in ODD_TEXTS if t], *[r.text for r in documents.select("text").collect()]]:
        assert encoded(encoder, text) == library.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a", "ab", "eth ing".replace(" ", ""), "!.-", "éßa"])
def test_a_window_of_the_lookahead_gives_the_tokens_of_the_whole_word(encoder, library, alphabet):
    pick = random.Random(alphabet)
    for size in (1, 10, 1500, 6000):
        word = "".join(pick.choice(alphabet) for _ in range(size))
        transducer, out, most = WordTransducer(encoder.merges), [], 0
        for k in range(0, len(word), 7):  # fed in small portions
            out += transducer.push(word[k : k + 7].encode())
            most = max(most, len(transducer.held))
        out += transducer.finish()
        assert out == library.encode(word, add_special_tokens=False).ids
        assert most <= 2 * transducer.window


def test_lookahead_is_that_of_the_merge_list(encoder):
    assert 0 < encoder.merges.lookahead < 10_000


def test_decoding_in_pieces_equals_the_library(encoder, library, documents):
    for text in [*HARD, *[r.text for r in documents.limit(40).collect()]]:
        ids = encoded(encoder, text)
        decoder, out = Decoder(encoder.merges, library=True), ""
        for k in range(0, len(ids), 3):
            out += decoder.push(ids[k : k + 3])
        assert out == library.decode(ids, skip_special_tokens=False)


def test_words_come_back_from_their_bytes(encoder):
    for text in ("the old mill", "über 中文 😀 straße", "x" * 500):
        decoder = Decoder(encoder.merges)
        out = "".join(decoder.push([i]) for i in encoded(encoder, text)) + decoder.finish()
        assert out.split() == [w for w in text.lower().split()]


def test_digests(odd_documents, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for d in odd_documents.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        wanted.append((d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in digest_documents(odd_documents, NAME).collect()), key=order) == sorted(wanted, key=order)


def test_columns(odd_documents, empty_documents, library):
    out = decode_ids(encode_texts(odd_documents, NAME), NAME, library=True)
    assert dict(out.dtypes)["ids"] == "array<int>" and set(odd_documents.columns) <= set(out.columns)
    for r in out.select("text", "ids", "decoded").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert digest_documents(empty_documents, NAME).count() == 0
