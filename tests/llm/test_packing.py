import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowsift.llm.packing import best_fit, cut_points, document_pieces, pack_documents, pack_pieces
from flowsift.llm.queries import vocabulary
from flowsift.llm.tokens import text_encoder

NAME = vocabulary("byte_bpe_50k.json")


def plain_best_fit(lengths, capacity):
    room = []
    for need in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= need]
        if fits:
            room[min(fits)[1]] -= need
        else:
            room.append(capacity - need)
    return sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_the_plain_search(seed):
    random = np.random.default_rng(seed)
    capacity = int(random.integers(1, 70))
    lengths = random.integers(1, capacity + 1, 300)
    numbers, offsets = best_fit(lengths, capacity)
    filled = np.bincount(numbers, weights=lengths)
    assert sorted(capacity - filled) == plain_best_fit(lengths.tolist(), capacity)
    check_sequences(zip(numbers.tolist(), offsets.tolist(), lengths.tolist()), capacity)


def check_sequences(rows, capacity):
    bins = defaultdict(list)
    for number, offset, length in rows:
        bins[number].append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("total", [1, 7, 8, 9, 16, 17, 100])
def test_only_the_first_piece_is_short(total):
    cuts = cut_points(total, 8)
    assert [s for s, _ in cuts] == [sum(n for _, n in cuts[:i]) for i in range(len(cuts))]
    assert sum(n for _, n in cuts) == total and all(n == 8 for _, n in cuts[1:])


def check(docs, capacity):
    model = Tokenizer.from_file(NAME)
    wanted = []
    for d in docs.collect():
        ids = np.array([*model.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted += [(d.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_points(len(ids), capacity))]
    rows = pack_documents(docs, capacity, NAME).collect()
    order = lambda r: (r[0] is None, *[x or 0 for x in r[:5]])
    assert sorted((tuple(r[:5]) for r in rows), key=order) == sorted(wanted, key=order)
    return check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], capacity), [w[3] for w in wanted]


def test_documents(documents):
    sequences, lengths = check(documents, 2048)
    assert sequences == len(plain_best_fit(lengths, 2048))


def test_odd_documents(odd_documents):
    check(odd_documents, 64)


def test_empty(empty_documents):
    assert pack_documents(empty_documents, 2048, NAME).count() == 0


def test_groups_hold_all_pieces(documents):
    pieces = document_pieces(documents, 256, NAME).cache()
    packed = pack_pieces(pieces, 256, group_pieces=100).collect()
    assert len(packed) == pieces.count()
    sequences = check_sequences([(r.sequence_id, r.offset, r.length) for r in packed], 256)
    groups = -(-len(packed) // 100)
    assert sequences <= len(plain_best_fit([r.length for r in packed], 256)) + groups
    pieces.unpersist()


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "word " + " \n\t" * 700_000 + "end", ("x" + " " * 9_999) * 50])
def test_long_white_space(text):
    encoder = text_encoder(vocabulary("byte_bpe_50k.json"))
    assert encoder.ids(text).tolist() == encoder.own.encode(text, add_special_tokens=False).ids
