"""Ranked lexical search: every item's best documents by integer term scores, found by grouping documents by the terms they hold.

The scan turns runs of documents into segments: for each term of the items, the places of the documents that hold it. In a segment,
an item's term bitmaps are read across, which gives each document's mask of present terms. Documents of equal masks share an upper bound, the sum of
the terms' largest scores in the segment, so masks are evaluated by descending bound until it falls below the tenth score at hand.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowsift.session import materialise

SEGMENT_DOCS = 1 << 14  # documents whose bitmaps are read together; places fit 16 bits
SEGMENT_POSTINGS = 1 << 20
VOCABULARY_BYTES = 4 << 20  # of the items' terms that one pass over the documents carries
TEXT_CHUNK = 1 << 20
MASK_CELLS = 1 << 22  # documents x terms of the masks formed at once
FIRST_DOCS = 32

#: Bytes of terms, with A-Z lower-cased; all other bytes separate. Bytes over 0x7F are parts of characters over U+007F.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def chunks_of_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded stretch at a time; a term is never cut."""
    plain, start = text.translate(TERM_BYTES), 0
    while start < len(plain):
        end = start + TEXT_CHUNK
        if end < len(plain):
            cut = plain.find(b" ", end)
            end = len(plain) if cut < 0 else cut
        yield plain[start:end].split()
        start = end


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their distinct terms."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        terms = [sorted({t for chunk in chunks_of_terms(text or b"") for t in chunk}) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_item"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["_item", "item_id", "_terms"]
        )


SEGMENT_TYPE = (
    "_docs array<bigint>, _lengths array<bigint>, _terms array<int>, _df array<int>, _places binary, _tf binary, _tf_bytes int"
)
SEGMENT_SCHEMA = pa.schema(
    [("_docs", pa.list_(pa.int64())), ("_lengths", pa.list_(pa.int64())), ("_terms", pa.list_(pa.int32())), ("_df", pa.list_(pa.int32())),
     ("_places", pa.binary()), ("_tf", pa.binary()), ("_tf_bytes", pa.int32())]
)


class SegmentBuilder:
    """Collects documents until they fill a segment."""

    def __init__(self, numbers: dict[bytes, int]) -> None:
        self.numbers = numbers
        self.clear()

    def clear(self) -> None:
        self.docs, self.lengths = [], []
        self.terms, self.tf, self.held = array("i"), array("q"), array("i")

    def add(self, doc_id: int | None, text: bytes) -> None:
        found, length = Counter(), 0
        for chunk in chunks_of_terms(text):
            found.update(map(self.numbers.get, chunk))
            length += len(chunk)
        if not length:
            return
        found.pop(None, None)
        self.docs.append(doc_id)
        self.lengths.append(length)
        self.terms.extend(found.keys())
        self.tf.extend(found.values())
        self.held.append(len(found))

    def full(self) -> bool:
        return len(self.docs) >= SEGMENT_DOCS or len(self.terms) >= SEGMENT_POSTINGS

    def segment(self) -> pa.RecordBatch:
        terms, tf = np.frombuffer(self.terms, np.int32), np.frombuffer(self.tf, np.int64)
        places = np.repeat(np.arange(len(self.docs)), np.frombuffer(self.held, np.int32))
        order = np.argsort(terms, kind="stable")  # places stay ascending within a term
        present, df = np.unique(terms, return_counts=True)
        width = next(w for w in (1, 2, 4, 8) if not tf.size or int(tf.max()) < 1 << 8 * w)
        row = [self.docs, self.lengths, present, df, places[order].astype(np.uint16).tobytes(), tf[order].astype(f"u{width}").tobytes(), width]
        batch = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENT_SCHEMA)], schema=SEGMENT_SCHEMA)
        self.clear()
        return batch


def segments_of(numbers: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (doc_id, text) -> segments. Documents without a term are in none."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = SegmentBuilder(numbers)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for doc_id, text in zip(ids, texts):
                if text.is_valid:
                    builder.add(doc_id.as_py(), text.as_py())
                    if builder.full():
                        yield builder.segment()
        if builder.docs:
            yield builder.segment()

    return build


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, their terms in all, and each term's weight."""

    documents: int
    terms: int
    weights: np.ndarray

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """The length part of each document's scores, in whole numbers."""
        if 90 * int(lengths.max()) * self.documents >= 1 << 63:
            return np.array([10 + 90 * int(n) * self.documents // self.terms for n in lengths], dtype=np.int64)
        return 10 + 90 * lengths * self.documents // self.terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Segment:
    """One segment: scores of its postings, bounds and bitmaps of its terms."""

    def __init__(self, row: dict, corpus: Corpus) -> None:
        self.docs = row["_docs"]
        self.terms = np.array(row["_terms"], dtype=np.int64)
        df = np.array(row["_df"], dtype=np.int64)
        self.places = np.frombuffer(row["_places"], np.uint16)
        tf = np.frombuffer(row["_tf"], f"u{row['_tf_bytes']}").astype(np.int64)
        damping = corpus.damping(np.array(row["_lengths"], dtype=np.int64))
        part = 1_000_000_000 * tf // (1000 * tf + 8 * damping[self.places]) if tf.size else tf
        self.scores = np.repeat(corpus.weights[self.terms], df) * part
        self.ends = np.cumsum(df)
        self.starts = self.ends - df
        self.bounds = np.maximum.reduceat(self.scores, self.starts) if tf.size else tf
        self.slot = {int(t): k for k, t in enumerate(self.terms)}
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, k: int) -> np.ndarray:
        """The documents that hold the segment's term ``k``, one bit each."""
        if k not in self.bitmaps:
            bits = np.zeros(len(self.docs), dtype=np.uint8)
            bits[self.places[self.starts[k] : self.ends[k]]] = 1
            self.bitmaps[k] = np.packbits(bits)
        return self.bitmaps[k]

    def score(self, slots: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for some terms."""
        total = np.zeros(len(docs), dtype=np.int64)
        for k in slots:
            places = self.places[self.starts[k] : self.ends[k]]
            at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
            total += np.where(places[at] == docs, self.scores[self.starts[k] : self.ends[k]][at], 0)
        return total

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Put this segment's documents into an item's best ones."""
        slots = np.array([self.slot[t] for t in terms if t in self.slot], dtype=np.int64)
        slots = slots[self.bounds[slots] > 0]
        if not slots.size:
            return
        slots = slots[np.argsort(-self.bounds[slots], kind="stable")]
        bounds = self.bounds[slots]
        rest = np.cumsum(bounds[::-1])[::-1]
        needed = int((rest >= max(best.least, 1)).sum())  # who holds none of these terms cannot enter
        if not needed:
            return
        union = self.bitmap(slots[0])
        for k in slots[1:needed]:
            union = union | self.bitmap(k)
        docs = np.flatnonzero(np.unpackbits(union, count=len(self.docs)))
        step = max(MASK_CELLS // slots.size, 256)
        for start in range(0, docs.size, step):
            self.search_masks(slots, bounds, docs[start : start + step], best)

    def search_masks(self, slots: np.ndarray, bounds: np.ndarray, docs: np.ndarray, best: Best) -> None:
        """Group documents by the mask of their terms and evaluate masks by descending bound until none can enter."""
        across = np.stack([np.unpackbits(self.bitmap(k), count=len(self.docs))[docs] for k in slots])
        masks = np.ascontiguousarray(np.packbits(across, axis=0).T)
        if masks.shape[1] <= 8:
            wide = np.zeros((len(docs), 8), dtype=np.uint8)
            wide[:, : masks.shape[1]] = masks
            keys = wide.view(np.uint64)[:, 0]
        else:
            keys = masks.view(np.dtype((np.void, masks.shape[1])))[:, 0]
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        limits = bounds @ across[:, first].astype(np.int64)
        order = np.argsort(-limits[group], kind="stable")  # documents, mask by mask
        descending, at, size = -limits[group][order], 0, FIRST_DOCS
        while at < order.size:
            possible = int(np.searchsorted(descending, -max(best.least, 1), side="right"))
            if at >= possible:
                return
            some = order[at : min(at + size, possible)]
            best.add(self.score(slots, docs[some]), [self.docs[d] for d in docs[some]])
            at, size = at + size, size * 2


class Best:
    """The ``k`` best documents of an item so far: highest score, then smallest doc_id, null first."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 0

    def add(self, scores: np.ndarray, docs: list[int | None]) -> None:
        new = [(-int(s), d is not None, d or 0) for s, d in zip(scores, docs) if s >= max(self.least, 1)]
        if new:
            self.rows = sorted(self.rows + new)[: self.k]
            self.least = -self.rows[-1][0] if len(self.rows) == self.k else 0


FOUND_TYPE = "_item bigint, item_id bigint, doc_id bigint, score bigint"
FOUND_SCHEMA = pa.schema([("_item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def searcher(items: list[tuple[int, int | None, np.ndarray]], corpus: Corpus, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments -> each item's best documents among those of the task. Scores found in one segment bound the work in the next."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for n in range(batch.num_rows):
                segment = Segment(batch.slice(n, 1).to_pylist()[0], corpus)
                for (_, _, terms), found in zip(items, best):
                    segment.search(terms, found)
        rows = [(item, item_id, d if known else None, -s) for (item, item_id, _), b in zip(items, best) for s, known, d in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND_SCHEMA)], schema=FOUND_SCHEMA) if rows else pa.RecordBatch.from_pylist([], FOUND_SCHEMA)

    return search


def in_passes(items: DataFrame) -> tuple[DataFrame, int]:
    """Deal items into passes (``_pass``) whose terms have no more than ``VOCABULARY_BYTES``; a larger item has a pass of its own size."""
    weighed = items.withColumn("_bytes", F.expr("aggregate(_terms, 0L, (n, t) -> n + octet_length(t) + 8)"))
    passes = max(1, math.ceil((weighed.agg(F.sum("_bytes")).first()[0] or 0) / VOCABULARY_BYTES))
    while True:
        dealt = weighed.withColumn("_pass", F.pmod(F.xxhash64("_item"), F.lit(passes)))
        heavy = dealt.groupBy("_pass").agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"))
        if heavy.filter((F.col("b") > VOCABULARY_BYTES) & (F.col("n") > 1)).isEmpty():
            return dealt, passes
        passes *= 2


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    Returns item_id, rank (from 1), doc_id, score; equal scores go by ascending doc_id, null first, then in any order. A null or empty
    text has no terms: as a document it is not counted, as an item it finds nothing. Repeated documents are ranked each, repeated items
    answered each. Other columns take no part. No documents or no items: no rows.

    Items are a query set: their terms are carried to the documents, in passes of a bounded size. Documents are read once a pass, and nothing but
    each task's ``k`` best rows of an item is shuffled.
    """
    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = materialise(slim.withColumn("_item", F.monotonically_increasing_id()), "items")
    told = materialise(numbered.mapInArrow(item_terms, "_item long, item_id long, _terms array<binary>"), "item_terms")
    dealt, passes = in_passes(told.filter(F.size("_terms") > 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for number in range(passes):
        rows = dealt.filter(F.col("_pass") == number).select("_item", "item_id", "_terms").collect()  # bounded by in_passes
        numbers = {t: n for n, t in enumerate(sorted({bytes(t) for r in rows for t in r["_terms"]}))}
        segments = materialise(texts.mapInArrow(segments_of(numbers), SEGMENT_TYPE), "segments")
        sums = segments.agg(
            F.sum(F.size("_docs")), F.sum(F.expr("aggregate(_lengths, 0L, (n, x) -> n + x)"))
        ).first()
        counts = segments.select(F.explode(F.arrays_zip("_terms", "_df")).alias("t")).groupBy("t._terms").agg(F.sum("t._df").alias("df"))
        weights = np.zeros(len(numbers), dtype=np.int64)
        for r in counts.collect():  # a row a term of the pass at most
            weights[r["_terms"]] = weight(sums[0], r["df"])
        corpus = Corpus(sums[0] or 0, sums[1] or 0, weights)
        queries = [(r["_item"], r["item_id"], np.array(sorted(numbers[bytes(t)] for t in r["_terms"]), dtype=np.int64)) for r in rows]
        hits = segments.mapInArrow(searcher(queries, corpus, k), FOUND_TYPE)
        found = hits if found is None else found.unionAll(hits)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
