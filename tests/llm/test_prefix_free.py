import hashlib
import random

import numpy as np
import pytest

from flowsift.llm import prefix_free
from flowsift.llm.prefix_free import Passages, Slice, repeated_strings, rolling, window_minimum, without_repeats
from tests.llm.conftest import SCHEMA, prose


def plain(rows, span=50):
    """Every string of every document, and the smallest document it starts in."""
    order, first = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows], {}
    texts = [(r["text"] or "").encode() for r in rows]
    for key, t in zip(order, texts):
        for i in range(len(t) - span + 1):
            s = hash(t[i : i + span])
            first[s] = min(first.get(s, key), key)
    out = []
    for r, key, t in zip(rows, order, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if first[hash(t[i : i + span])] < key:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)
        out.append((r["doc_id"], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r[n] for n in names) for r in without_repeats(df, **options).collect()), key=repr)


SMALL = Passages(gram=12, phrase_bits=4, block_bytes=3000, piece_bytes=700, bucket_bytes=20_000, hot=3, sorted_strings=500)


def test_documents(documents):
    rows = found(documents)
    assert rows == plain(documents.collect())
    assert any(r[2] for r in rows) and any(not r[2] for r in rows)


def test_odd_documents(odd_documents):
    assert found(odd_documents) == plain(odd_documents.collect())


def test_empty(empty_documents):
    assert without_repeats(empty_documents).count() == 0


def test_copies_passages_runs_and_long_documents_in_small_blocks(spark):
    pick, shared = random.Random(3), [prose(n, 90 + n) for n in (9, 12, 30, 200)]
    texts = [" ".join(pick.choice([prose(pick.randrange(1, 40), i * 7 + k), pick.choice(shared)]) for k in range(pick.randrange(6))) for i in range(150)]
    texts += ["a" * 5000, "b" + "a" * 300, "ab" * 900, "aé中😀" * 300, "x" + "aé中😀" * 20, shared[3] * 5, shared[3], shared[2][:50], shared[2][:49], shared[2][1:51]]
    texts += [f"{i} {shared[0]} {i}" for i in range(30)]
    ids = list(range(len(texts)))
    pick.shuffle(ids)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in zip(ids, texts)] + [(None, shared[1], None, None, 0), (5, shared[1], None, None, 0)], SCHEMA).repartition(4)
    assert found(df, rule=SMALL) == plain(df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_two_letters(spark, seed):
    pick = random.Random(seed)
    df = spark.createDataFrame([(i, "".join(pick.choices("ab", k=pick.randrange(400))), None, None, 0) for i in range(60)], SCHEMA)
    rule = Passages(span=14, gram=5, phrase_bits=2, block_bytes=900, piece_bytes=150, bucket_bytes=2000, hot=2, sorted_strings=50)
    assert found(df, rule=rule) == plain(df.collect(), 14)


def test_rolling_hashes_depend_on_their_bytes_alone():
    data = np.frombuffer(b"the same words, then the same words again" * 3, np.uint8)
    hashes = rolling(data, 10)
    strings = [data[i : i + 10].tobytes() for i in range(len(hashes))]
    assert len(set(zip(strings, hashes.tolist()))) == len(set(strings)) == len(set(hashes.tolist()))


def test_window_minimum():
    values = np.random.default_rng(1).integers(0, 100, 200).astype(np.uint64)
    for width in (1, 2, 7, 8, 27):
        assert window_minimum(values, width).tolist() == [values[i : i + width].min() for i in range(200 - width + 1)]


def test_phrases_divide_the_strings_of_each_piece():
    texts = [prose(60, 1).encode(), b"short", b"", prose(300, 2).encode(), b"a" * 3000]
    s = Slice(Passages(phrase_bits=4), b"".join(texts), np.array([len(t) for t in texts]), np.arange(5))
    first, last, keys = s.phrases()
    at = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
    assert at.tolist() == np.flatnonzero(s.starts()).tolist()
    assert set(keys.tolist()) == {0, 3, 4} and (keys == 4).sum() < 100


def test_repeated_strings_in_shares():
    random_ = np.random.default_rng(2)
    data = random_.integers(0, 2, 3000).astype(np.uint8)
    places, keys = np.arange(2980), random_.integers(0, 50, 2980)
    smallest = {}
    for p, k in zip(places, keys):
        s = data[p : p + 20].tobytes()
        smallest[s] = min(smallest.get(s, k), k)
    wanted = [k > smallest[data[p : p + 20].tobytes()] for p, k in zip(places, keys)]
    for at_once in (100, 10_000):
        assert repeated_strings(data, places, keys, 20, at_once).tolist() == wanted
