import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowsift.llm import lexical
from flowsift.llm.lexical import Best, Corpus, Segment, rank_documents
from tests.llm.conftest import ODD_TEXTS, SCHEMA, lowered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lowered(text))


def plain(docs, items, k=10):
    bags = [(d, Counter(t)) for d, t in ((d, terms(text)) for d, text in docs) if t]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in set(terms(text)) & bag.keys()
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in rank_documents(docs, items, **options).collect()), key=repr)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_benchmark_items(spark, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert found(documents, items) == plain(pairs(documents, "doc_id"), pairs(items, "item_id"))


def test_odd_documents_and_items(spark, odd_documents):
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD_TEXTS, "river1 RIVER1 river2", "absent"])] + [(None, "one", "y"), (3, "one", "z"), (3, "one", "z")], "item_id int, text string, doc_id string")
    assert found(odd_documents, items) == plain(pairs(odd_documents, "doc_id"), pairs(items, "item_id"))


def test_ties_and_fewer_than_k(spark):
    docs = spark.createDataFrame([(i, f"same words here {i % 3}") for i in range(40, 0, -1)] + [(99, "others"), (None, "same")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "same words"), (2, "others"), (3, "2 here")], "item_id long, text string")
    assert found(docs, items) == plain(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert found(docs, items, k=3) == plain(pairs(docs, "doc_id"), pairs(items, "item_id"), 3)


def test_empty_tables(spark, empty_documents, documents):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert rank_documents(empty_documents, items).count() == 0
    assert rank_documents(documents, items.limit(0)).count() == 0


def test_passes(spark, documents, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "VOCABULARY_BYTES", 3000)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    told = spark.createDataFrame([(i, [b"x" * 1000] * (9 if i == 4 else 1)) for i in range(9)], "_item long, _terms array<binary>")
    assert lexical.in_passes(told)[1] > 3
    assert found(documents, items) == plain(pairs(documents, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize("seed", range(5))
def test_segments_of_few_documents(seed, monkeypatch):
    pick = random.Random(seed)
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 50)
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", 700)
    monkeypatch.setattr(lexical, "TEXT_CHUNK", 7)
    monkeypatch.setattr(lexical, "MASK_CELLS", 2000)
    monkeypatch.setattr(lexical, "FIRST_DOCS", 2)
    words = [f"w{int(pick.paretovariate(0.6)) % 150}" for _ in range(4000)]
    docs = [(i, " ".join(pick.choices(words, k=pick.choice([0, 1, 5, 30, 300])))) for i in range(400)]
    items = [(i, " ".join(pick.choices(words, k=pick.choice([1, 3, 20, 200])))) for i in range(30)]
    asked = [(i, sorted(set(terms(t)))) for i, t in items]
    numbers = {t.encode(): n for n, t in enumerate(sorted({t for _, ts in asked for t in ts}))}
    batches = [pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in docs])]
    rows = [r for b in lexical.segments_of(numbers)(iter(batches)) for r in b.to_pylist()]
    assert len(rows) >= 8
    df = np.zeros(len(numbers), np.int64)
    for r in rows:
        df[r["_terms"]] += r["_df"]
    n_docs, total = sum(len(r["_docs"]) for r in rows), sum(sum(r["_lengths"]) for r in rows)
    corpus = Corpus(n_docs, total, np.array([lexical.weight(n_docs, int(n)) for n in df]))
    out = []
    for item, ts in asked:
        best = Best(10)
        for r in rows:
            Segment(r, corpus).search(np.array([numbers[t.encode()] for t in ts]), best)
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(best.rows, 1)]
    assert sorted(out, key=repr) == plain(docs, items)


def test_masks_that_cannot_enter_are_not_scored():
    docs = [(i, "common " + ("rare" if i < 12 else "filler")) for i in range(3000)]
    numbers = {b"common": 0, b"rare": 1}
    (batch,) = lexical.segments_of(numbers)(iter([pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in docs])]))
    corpus = Corpus(3000, 6000, np.array([lexical.weight(3000, 3000), lexical.weight(3000, 12)]))
    segment, scored = Segment(batch.to_pylist()[0], corpus), []
    score = segment.score
    segment.score = lambda slots, some: scored.append(len(some)) or score(slots, some)
    best = Best(10)
    segment.search(np.array([0, 1]), best)
    segment.search(np.array([0, 1]), best)
    assert [r[2] for r in best.rows][::2] == [0, 1, 2, 3, 4] and sum(scored) < 100


def test_large_corpora_keep_exact_damping():
    corpus = Corpus(10**12, 10**15, np.zeros(0))
    assert corpus.damping(np.array([10**6])).tolist() == [10 + 90 * 10**6 * 10**12 // 10**15]
