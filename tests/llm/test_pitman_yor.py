import math
import zlib
from collections import Counter

import numpy as np
import pytest

from flowsift.llm import pitman_yor as py
from flowsift.llm.pitman_yor import Corpus, Settings, log_stirling, pack, sample_seating, score_documents, seat, unpack
from tests.llm.conftest import SCHEMA, WORD, lowered, prose


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def check(docs, settings=Settings()):
    rows = score_documents(docs, settings).collect()
    texts = [(d.doc_id, [*WORD.findall(lowered(d.text)), None]) for d in docs.collect()]
    counts = Counter(w for key, words in texts if not held(key) for w in words)
    n, v = sum(counts.values()), len(counts)
    wanted = Counter(
        (key, held(key), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 4))
        for key, words in texts
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == wanted
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in rows)
    return rows


def test_documents(documents):
    rows = [r for r in check(documents) if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_documents(odd_documents):
    rows = check(odd_documents)
    by_text = Counter(r.score for r in rows if r.n_tokens == 1)
    assert len(by_text) == 1  # null, empty and blank texts are scored alike


def test_empty_and_untrained(spark, empty_documents):
    assert score_documents(empty_documents).count() == 0
    only = next(k for k in range(100) if held(k))
    rows = score_documents(spark.createDataFrame([(only, "a b c", "en", "h", 0)], SCHEMA)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(True, 4, 0, 0)]


@pytest.fixture(scope="module")
def bigrams(spark):
    """Texts in which a word determines the next one."""
    rows = []
    for i in range(150):
        words = prose(120, i).split()
        rows.append((i, " ".join(f"key{len(w) % 3} {w.rstrip('0123456789')}{len(w) % 3}" for w in words), "en", "h", 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_contexts_help(bigrams):
    rows = [r for r in check(bigrams) if r.held_out]
    alone = [r for r in check(bigrams, Settings(context_share=2.0)) if r.held_out]
    per_token = lambda part: sum(r.score for r in part) / sum(r.n_tokens for r in part)
    assert per_token(rows) > per_token(alone) + 0.2


def test_blocks_and_parts_do_not_change_the_counts(bigrams):
    small = Settings(block_tokens=500, part_tokens=4_000)
    one = {r.doc_id: r.score for r in check(bigrams)}
    many = {r.doc_id: r.score for r in check(bigrams, small)}
    assert all(abs(one[k] - many[k]) < 0.02 * abs(one[k]) for k in one)  # other random numbers, same counts


def test_probabilities_sum_to_one(bigrams):
    settings = Settings(part_tokens=10_000)
    counted = py.counted_blocks(bigrams, settings, 2)
    corpus = py.learn_corpus(counted, settings)
    asked = py.materialise(py.messages(counted, corpus, settings))
    model = py.learn_model(asked, py.materialise(py.answers(asked, corpus, settings, 2)), corpus, settings)
    words = Counter(w for d in bigrams.collect() if not held(d.doc_id) for w in {*WORD.findall(lowered(d.text)), None})
    assert corpus.types == len(words) and len(corpus.frequent) == corpus.types  # all words are frequent here
    parent = np.append(model.parent(model.word_weight), model.parent(np.zeros(1)))
    assert abs(parent.sum() - 1) < 1e-9
    for context in range(len(corpus.frequent)):
        weight = np.append(model.pair_weight[context], 0.0)
        assert abs(model.after(np.full(len(weight), context), weight, parent).sum() - 1) < 1e-9


def test_numbers_of_tables_follow_their_distribution():
    """Against seating every customer of a dish by hand, corrected for the dish's own order."""
    d, mass, n = 0.6, 0.7, 6
    table = log_stirling(d)
    drawn = seat(np.full(40_000, n), np.full(40_000, mass), d, table, np.random.Generator(np.random.Philox(1)))
    exact = {1: {1: 1.0}}
    for k in range(1, n):
        exact[k + 1] = {t: exact[k].get(t - 1, 0) + (k - d * t) * exact[k].get(t, 0) for t in range(1, k + 2)}
    weights = {t: s * mass**t for t, s in exact[n].items()}
    total = sum(weights.values())
    for t, w in weights.items():
        assert abs((drawn == t).mean() - w / total) < 0.01
        assert math.isclose(math.exp(table[n, t]), exact[n][t], rel_tol=1e-9)


def test_large_dishes_have_tables_within_bounds():
    customers = np.array([0, 1, 2, 64, 65, 1_000, 1_000_000_000])
    tables = seat(customers, np.full(7, 0.5), 0.8, log_stirling(0.8), np.random.Generator(np.random.Philox(2)))
    assert tables[0] == 0 and tables[1] == 1 and all(1 <= t <= c for t, c in zip(tables[2:], customers[2:]))


def test_seating_repeats():
    corpus = Corpus(100, 3, 0.5, np.array([5], np.int64), np.array([60]))
    args = (corpus, Settings(), np.array([60, 30, 10]), np.array([0, 1]), np.array([0, 0]), np.array([20, 15]))
    assert (sample_seating(*args, 7).word_weight == sample_seating(*args, 7).word_weight).all()


def test_packing():
    arrays = [np.arange(5, dtype=np.uint64) << 40, np.zeros(0, np.int32), np.array([1.5, -2.0]), np.array([1, 0], np.uint8)]
    again = unpack(pack(arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, again)) and len(again) == 4


def test_rare_contexts_count(spark):
    """Words far below the frequent ones' share determine the next word, also when that is frequent."""
    rows = []
    for i in range(400):
        k = i % 200
        rows.append((i, f"left{k} right{k} the left{k} right{k} the odd{k} the", "en", "h", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    settings = Settings(frequent_share=1 / 20, block_tokens=300, part_tokens=700)
    corpus = py.learn_corpus(py.counted_blocks(docs, settings), settings)
    assert len(corpus.frequent) == 2  # the end and "the"
    rows = [r for r in check(docs, settings) if r.held_out]
    only_frequent = [r for r in check(docs, Settings(context_share=1 / 20, frequent_share=1 / 20)) if r.held_out]
    per_token = lambda part: sum(r.score for r in part) / sum(r.n_tokens for r in part)
    assert per_token(rows) > per_token(only_frequent) + 0.3


def test_rare_contexts_sum_to_one(spark):
    """What the pairs of a context lack of its customers is the discount of its tables, so its chances add up to one."""
    rows = [(i, f"a{i % 7} b{i % 5} the a{i % 7} the", "en", "h", 0) for i in range(300)]
    settings = Settings(frequent_share=1 / 5, part_tokens=400)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    counted = py.counted_blocks(docs, settings)
    corpus = py.learn_corpus(counted, settings)
    assert counted.parts > 1
    asked = py.materialise(py.messages(counted, corpus, settings))
    answered = py.materialise(py.answers(asked, corpus, settings, counted.parts))
    by_part = lambda df, k: np.concatenate([unpack(r.payload)[k] for r in sorted(df.collect(), key=lambda r: r.part)])
    tables = by_part(py.context_tables(counted, answered), 0)
    numbers = sorted(py.numbers_of(counted).collect(), key=lambda r: r.part)
    block = py.block_of(counted.documents.first().payload, [r.payload for r in numbers], 1)
    hashes, counts = block.words, block.counts
    order = py.pair_order(py.found_at(corpus.frequent, hashes), hashes >> py.PART_BITS, block.pair_words, block.pair_contexts)
    pair_contexts = block.pair_contexts[np.concatenate(order)]
    weights = np.bincount(pair_contexts, weights=by_part(answered.filter("block >= 0"), 1), minlength=len(counts))
    rare = (py.found_at(corpus.frequent, hashes) < 0) & (counts > 0)
    assert rare.sum() >= 10 and (tables[rare] >= 1).all()
    assert np.allclose(weights[rare] + settings.discount * tables[rare], counts[rare])
