"""Language-model scores from a hierarchical Pitman-Yor model of words.

There are three levels. Every word is a context and has a restaurant whose dishes are the words that follow
it. All of them share one parent, the restaurant of single words; its own parent is uniform over the known words and
one unknown word. A table of a restaurant is a customer of its parent. Numbers of tables are sampled by Gibbs sweeps
and the predictive probabilities are averaged over them.

Where the work lies:

* Words are hashed to 64 bits by Spark in the only pass over the texts. Words with a share of ``frequent_share`` or more are the
  frequent ones, so there are 1 / ``frequent_share`` of them at most, and all counts among them fit in one small matrix.
* Documents are cut into blocks of some million tokens. A block sends each of its words once, with its counts, to the part of the
  hash range that the word falls into, and learns the word's number there and the counts of all blocks. From then on words
  go by these numbers, which are short. The block sends words with their contexts, the word's seating is sampled, and the
  block gets its answer in the order in which it asked. No word is ever sent once per occurrence.
* Frequent words after other contexts go to parts by the context instead, so the words and pairs of one part are bounded,
  whatever share a word has of the text. The parent's customers are scaled up there from the part's own to all.
* Each part adds up its tables by context and sends the sums to the part of the context, which tells all blocks that have it
  the context's tables.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import ascii_lower, forget, text_of, words_of
from flowsift.session import materialise

#: Stands for the end of a text, which is also the context of its first word.
END = np.int64(0x5851F42D4C957F2D)

TOLD_SCHEMA = "block long, part int, payload binary"
COUNT_SCHEMA = "block long, part int, payload binary, word long, n double"
MESSAGE_SCHEMA = "block long, part int, payload binary, context int, word int, n long"
ANSWER_SCHEMA = "block long, part int, payload binary, context int, tables double"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
DOCUMENTS = -1  # the part number of a block's own documents
TABLES = -1  # the block number of tables that are told to the part of their contexts
TOTALS = ("tokens", "types", "once", "twice", "tables")
PART_BITS = 40  # a word's number is its part, and its place among the part's words in so many bits
BYTES_A_TOKEN = 6  # as assumed for the number of parts
SMALL = 64  # customers up to which the number of tables is sampled exactly


@dataclass(frozen=True)
class Settings:
    """``discount`` and ``strength`` of the contexts' restaurants; the parent's discount comes from its counts.

    Words with less than ``context_share`` of the tokens have no restaurant: by default all have one, above 1 none has.
    """

    context_share: float = 0.0
    frequent_share: float = 1 / 500
    discount: float = 0.8
    strength: float = 1.0
    burn_in: int = 3
    samples: int = 5
    seed: int = 11
    block_tokens: int = 1_500_000
    part_tokens: int = 1_000_000


@dataclass(frozen=True)
class Corpus:
    """Totals of the training tokens; ``frequent`` holds the numbers of the frequent words, sorted, ``counts`` are theirs.

    ``customers`` is the mean number of the parent's customers, where known.
    """

    tokens: int
    types: int
    discount: float
    frequent: np.ndarray
    counts: np.ndarray
    customers: float | None = None


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes: same places of all numbers together, compressed."""
    squeeze, out = zstandard.ZstdCompressor(level=1), []
    for array in arrays:
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T
        data = squeeze.compress(planes.tobytes())
        out += [struct.pack("<2sQQ", array.dtype.str[1:].encode(), len(array), len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    arrays, at, loose = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, count, size = struct.unpack_from("<2sQQ", data, at)
        at += struct.calcsize("<2sQQ")
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(loose.decompress(data[at : at + size], max_output_size=max(1, count * dtype.itemsize)), np.uint8)
        arrays.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, count).T).reshape(-1).view(dtype))
        at += size
    return arrays


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: the checksum of its id as text. A null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 7 == 2


def hashed(docs: DataFrame) -> DataFrame:
    words = words_of(ascii_lower(text_of()))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.transform(words, lambda w: F.xxhash64(w)).alias("words")
    )


@dataclass
class Tokens:
    """The documents of a block: all tokens one after another, ends included."""

    ids: list
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Tokens]:
    """Documents of a task (doc_id, held_out, words) in blocks of about ``limit`` tokens."""

    def joined(rows: list[pa.RecordBatch]) -> Tokens:
        sizes = [batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1 for batch in rows]
        lengths = np.concatenate(sizes)
        tokens, at = np.full(lengths.sum(), END), 0
        for batch, own in zip(rows, sizes):  # straight from the batches, without a copy of them all
            inner = np.ones(own.sum(), dtype=bool)
            inner[np.cumsum(own) - 1] = False
            tokens[at : at + len(inner)][inner] = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            at += len(inner)
        ids = [i for batch in rows for i in batch.column(0).to_pylist()]
        held = np.concatenate([batch.column(1).to_numpy(zero_copy_only=False) for batch in rows]).astype(bool)
        return Tokens(ids, held, lengths, tokens)

    rows, size = [], 0
    for batch in batches:
        at = 0
        sizes = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False) + 1) if batch.num_rows else np.zeros(0)
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            take = max(1, int(np.searchsorted(sizes[at:], before + limit - size, side="right")))
            rows.append(batch.slice(at, take))
            at += take
            size += int(sizes[at - 1] - before)
            if size >= limit or at < batch.num_rows:
                yield joined(rows)
                rows, size = [], 0
    if rows:
        yield joined(rows)


@dataclass
class Counted:
    """Stored blocks: their documents, their words' numbers and counts by part, and the number of parts."""

    documents: DataFrame
    words: DataFrame
    parts: int


def learn_corpus(counted: Counted, settings: Settings) -> Corpus:
    """Totals of all training tokens; the driver gets these and the most frequent words only."""
    found = counted.words.filter("block IS NULL")
    totals = {TOTALS[-1 - r["part"]]: r["n"] for r in found.filter("part < 0").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    tokens, types, once, twice, tables = (totals.get(name, 0.0) for name in TOTALS)
    tokens = int(tokens)
    top = found.filter("part >= 0").select("word", "n").orderBy(F.desc("n"), "word").limit(most_frequent(settings)).collect()
    frequent = sorted((r["word"], int(r["n"])) for r in top if r["n"] >= settings.frequent_share * tokens)
    customers = tables
    if settings.context_share > 0:
        chosen = np.array([r["n"] for r in top if r["n"] >= least_count(tokens, settings)])
        customers = tokens + float((expected_tables(chosen, settings.discount, settings.strength) - chosen).sum())
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    return Corpus(tokens, int(types), discount, np.array([w for w, _ in frequent], np.int64), np.array([n for _, n in frequent], np.int64), customers)


def most_frequent(settings: Settings) -> int:
    """How many words can have the share of a frequent word or, where that is given, of a context."""
    return math.ceil(1 / min(s for s in (settings.frequent_share, settings.context_share) if s > 0))


def found_at(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value among the sorted ones, -1 where it isn't."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == values, at, -1)


def pairs_of(end: int, places: np.ndarray, lengths: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(tokens that are a known word after a context, their keys): a key is place * words + place of the token before.

    ``places`` are the tokens' places among the block's sorted words, ``end`` is that of a text's end, ``counts`` are the
    words' training tokens; contexts have ``least`` of them or more.
    """
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = end
    at = np.flatnonzero((counts[places] > 0) & (counts[before] >= least))
    return at, places[at].astype(np.int64) * len(counts) + before[at]


def parts_of(docs: DataFrame, settings: Settings) -> int:
    """The number of parts, by the size of the texts."""
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    return max(1, math.ceil(size / BYTES_A_TOKEN / settings.part_tokens))


def least_count(tokens: int, settings: Settings) -> float:
    """Training tokens, of all these, that a word needs to be a context."""
    return max(1.0, settings.context_share * tokens) if settings.context_share <= 1 else math.inf


def deltas(hashes: np.ndarray) -> np.ndarray:
    return np.diff(hashes.view(np.uint64), prepend=np.uint64(0))


def sums(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64).view(np.int64)


def batch_of(rows: list[tuple], schema: str, kind=pa.RecordBatch):
    """Rows as a record batch or table of a schema."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return kind.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def by_part(home: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(part, its stretch) of rising part numbers."""
    cuts = np.searchsorted(home, np.arange(parts + 1))
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        yield part, slice(cuts[part], cuts[part + 1])


def counted_blocks(docs: DataFrame, settings: Settings, parts: int | None = None) -> Counted:
    """Read the texts once, store them as blocks of tokens, and count their words."""
    parts = parts or parts_of(docs, settings)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(blocks_of(batches, settings.block_tokens)):
            block_id = (TaskContext.get().partitionId() << 20) + number
            words, places = np.unique(block.tokens, return_inverse=True)
            counts = np.bincount(places[np.repeat(~block.held, block.lengths)], minlength=len(words))
            ids = pa.array(block.ids, pa.int64())
            known = np.array([i is not None for i in block.ids], np.uint8)
            end = np.searchsorted(words, np.array([END]))
            mine = [ids.fill_null(0).to_numpy(), known, block.held.astype(np.uint8), block.lengths, places.astype(np.int32), end]
            rows = [(block_id, DOCUMENTS, pack(mine))]
            for part, here in by_part(part_of(words, parts), parts):
                rows.append((block_id, part, pack([deltas(words[here]), counts[here].astype(np.uint32)])))
            yield batch_of(rows, TOLD_SCHEMA)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        """A part's words from all blocks -> for each block their numbers and counts; the part's totals; its most frequent words."""
        part = key[0].as_py()
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
        hashes, counts = zip(*[(sums(h), n) for h, n in (unpack(data) for _, data in rows)])
        words = np.unique(np.concatenate(hashes))
        places, total = [np.searchsorted(words, h) for h in hashes], np.zeros(len(words), np.int64)
        for at, n in zip(places, counts):
            total[at] += n
        number = (np.int64(part) << PART_BITS) + np.arange(len(words))
        out = [(block, part, pack([deltas(number[at]), narrow(total[at])]), None, None) for at, (block, _) in zip(places, rows)]
        seen = total[total > 0]
        tables = expected_tables(seen, settings.discount, settings.strength).sum()
        found = (seen.sum(), len(seen), (seen == 1).sum(), (seen == 2).sum(), tables)
        out += [(None, -1 - k, None, None, float(value)) for k, value in enumerate(found)]
        top = np.argsort(-total, kind="stable")[: most_frequent(settings)]
        out += [(None, part, None, w, float(n)) for w, n in zip(number[top].tolist(), total[top].tolist()) if n]
        return batch_of(out, COUNT_SCHEMA, pa.Table)

    told = materialise(hashed(docs).mapInArrow(tell, TOLD_SCHEMA), "blocks")
    added = materialise(told.filter(F.col("part") >= 0).groupBy("part").applyInArrow(add, COUNT_SCHEMA), "words")
    return Counted(told.filter(F.col("part") == DOCUMENTS), added, parts)


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit."""
    return values.astype(np.uint32 if values.max(initial=0) < 2**32 else np.uint64)


def numbers_of(counted: Counted) -> DataFrame:
    """Per block and part, the numbers and counts of the block's words."""
    return counted.words.filter("block IS NOT NULL").select("block", "part", "payload")


@dataclass
class Block:
    """A block's documents and words, and its pairs in the order of their keys."""

    ids: np.ndarray
    known: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    places: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    where: np.ndarray
    pair_words: np.ndarray
    pair_contexts: np.ndarray


def block_of(documents: bytes, numbers: list[bytes], least: float) -> Block:
    """A block from its documents and its words' numbers and counts, by rising part; ``where`` is the pair of each token ``at``."""
    ids, known, held, lengths, places, end = unpack(documents)
    told = [unpack(data) for data in numbers]
    words, counts = np.concatenate([sums(n) for n, _ in told]), np.concatenate([n for _, n in told]).astype(np.int64)
    at, keys = pairs_of(end[0], places, lengths, counts, least)
    keys, where = np.unique(keys, return_inverse=True)
    return Block(ids, known, held, lengths, places, words, counts, at, where, keys // len(words), keys % len(words))


def messages(counted: Counted, corpus: Corpus, settings: Settings) -> DataFrame:
    """Per block: its words and their pairs for each part, and its counts among the frequent words.

    Part numbers from ``parts`` on are those of frequent words after other contexts, by the context.
    """
    frequent, least, parts = corpus.frequent, least_count(corpus.tokens, settings), counted.parts

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block_id = key[0].as_py()
        sent = sorted(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))
        block = block_of(sent[0][1], [data for _, data in sent[1:]], least)
        words, counts, pair_words, pair_contexts = block.words, block.counts, block.pair_words, block.pair_contexts
        train = np.repeat(block.held == 0, block.lengths)
        common = found_at(frequent, words)
        pair_counts = np.bincount(block.where[train[block.at]], minlength=len(pair_words))
        rows = []

        def named(pairs: np.ndarray) -> list[np.ndarray]:
            """The contexts of pairs, each once with its count, and the pairs' training tokens."""
            own, number = np.unique(pair_contexts[pairs], return_inverse=True)
            return [deltas(words[own]), narrow(counts[own]), number.astype(np.uint32), pair_counts[pairs].astype(np.uint32)]

        home, rare = words >> PART_BITS, np.flatnonzero((common < 0) & (counts > 0))
        own, others = pair_order(common, home, pair_words, pair_contexts)
        per_word = np.bincount(pair_words[own], minlength=len(words))
        cuts = np.searchsorted(pair_words[own], np.searchsorted(home, np.arange(parts + 1)))
        for part, here in by_part(home[rare], parts):
            mine = rare[here]
            columns = [deltas(words[mine]), narrow(counts[mine]), per_word[mine].astype(np.uint32)]
            rows.append((block_id, part, pack([*columns, *named(own[cuts[part] : cuts[part + 1]])]), None, None, None))
        for part, here in by_part(home[pair_contexts[others]], parts):
            mine = others[here]
            rows.append((block_id, parts + part, pack([common[pair_words[mine]].astype(np.uint32), *named(mine)]), None, None, None))
        both = (common[pair_words] >= 0) & (common[pair_contexts] >= 0) & (pair_counts > 0)
        among = zip(common[pair_contexts[both]].tolist(), common[pair_words[both]].tolist(), pair_counts[both].tolist())
        rows += [(None, None, None, c, w, n) for c, w, n in among]
        return batch_of(rows, MESSAGE_SCHEMA, pa.Table)

    return counted.documents.union(numbers_of(counted)).groupBy("block").applyInArrow(ask, MESSAGE_SCHEMA)


def pair_order(common: np.ndarray, home: np.ndarray, pair_words: np.ndarray, pair_contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of other words, by word; pairs of frequent words after other contexts, by the context's part)."""
    others = np.flatnonzero((common[pair_words] >= 0) & (common[pair_contexts] < 0))
    return np.flatnonzero(common[pair_words] < 0), others[np.argsort(home[pair_contexts[others]], kind="stable")]


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """The part of the range of signed hashes, in rising order."""
    return np.minimum(((words.astype(np.float64) / 2.0**64 + 0.5) * parts).astype(np.int64), parts - 1)


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: arrangements of n customers at t tables, for n up to ``SMALL``."""
    table = np.full((SMALL + 1, SMALL + 2), -np.inf)
    table[1, 1] = 0.0
    for n in range(1, SMALL):
        t = np.arange(1, SMALL + 1)
        grown = np.where(n - discount * t > 0, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf) + table[n, 1:-1]
        table[n + 1, 1:-1] = np.logaddexp(table[n, :-2], grown)
    return table


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, stirling: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish, given its customers and the weight of a new table.

    Up to ``SMALL`` customers it is drawn from its distribution given everything else, all arrangements counted. Further customers
    take their seats after these, in batches that are small against those seated.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    several = np.flatnonzero(customers > 1)  # few of the dishes
    few = np.minimum(customers[several], SMALL)
    several = several[np.argsort(few, kind="stable")]
    edges = np.searchsorted(np.sort(few), np.arange(2, SMALL + 2))
    for n, start, end in zip(range(2, SMALL + 1), edges, edges[1:]):
        if start == end:
            continue
        rows = several[start:end]
        choice = np.arange(1, n + 1)
        weights = stirling[n, 1 : n + 1] + choice * np.log(np.maximum(mass[rows, None], 1e-300))
        tables[rows] = choice[np.argmax(weights + random.gumbel(size=weights.shape), axis=1)]
    rows = np.flatnonzero(customers > SMALL)
    seated = np.full(len(rows), SMALL, dtype=np.int64)
    while rows.size:
        batch = np.minimum(customers[rows] - seated, seated // 16)
        chance = mass[rows] / (mass[rows] + seated - discount * tables[rows])
        tables[rows] += random.binomial(batch, np.clip(chance, 0.0, 1.0))
        seated += batch
        left = seated < customers[rows]
        rows, seated = rows[left], seated[left]
    return tables


def expected_tables(customers: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Mean number of tables of a Pitman-Yor restaurant before its dishes are known."""
    grown = np.exp(math.lgamma(strength + 1) - math.lgamma(strength + discount) + discount * np.log(np.maximum(customers, 1))) / discount
    return np.minimum(np.maximum(grown - strength / discount, 1.0), np.maximum(customers, 1))


@dataclass
class Seating:
    """Averages over the samples: customers less discounts, per word and per pair, and tables, per context and per pair."""

    word_weight: np.ndarray
    pair_weight: np.ndarray
    context_tables: np.ndarray
    customers: float
    tables: float
    pair_tables: np.ndarray


def sample_seating(
    corpus: Corpus,
    settings: Settings,
    counts: np.ndarray,
    pair_word: np.ndarray,
    pair_context: np.ndarray,
    pair_counts: np.ndarray,
    seed: int,
    wide: np.ndarray | None = None,
    direct: np.ndarray | None = None,
    scale: np.ndarray | None = None,
) -> Seating:
    """Gibbs sweeps over the dishes of some words: tables in the contexts given the parent, then tables of the parent.

    Totals of restaurants are held at their means during the sweeps, ``wide`` those of the contexts, which are the frequent
    words unless given. ``direct`` are customers of the parent that come from no pair here; a pair's tables stand for
    ``scale`` times as many.
    """
    random = np.random.Generator(np.random.Philox(key=[settings.seed, seed]))
    d, d0, strength = settings.discount, corpus.discount, settings.strength
    if wide is None:
        wide = expected_tables(corpus.counts, d, strength) if len(corpus.counts) else np.ones(1)
    total = corpus.customers or corpus.tokens - corpus.counts.sum() + expected_tables(corpus.counts, d, strength).sum()
    uniform = (strength + d0 * corpus.types) / (corpus.types + 1)
    inner, outer = log_stirling(d), log_stirling(d0)
    if direct is None:
        direct = counts - np.bincount(pair_word, weights=pair_counts, minlength=len(counts)).astype(np.int64)
    scale = np.ones(len(pair_counts)) if scale is None else scale
    held, top = np.minimum(pair_counts, 1), np.minimum(counts, 1)
    added = [np.zeros(len(counts)), np.zeros(len(pair_counts)), np.zeros(len(pair_counts)), np.zeros(len(counts)), np.zeros(len(counts))]
    for sweep in range(settings.burn_in + settings.samples):
        customers = direct + np.rint(np.bincount(pair_word, weights=held * scale, minlength=len(counts))).astype(np.int64)
        parent = (customers - d0 * np.minimum(top, customers) + uniform) / (strength + total)
        held = seat(pair_counts, (strength + d * wide[pair_context]) * parent[pair_word], d, inner, random)
        customers = direct + np.rint(np.bincount(pair_word, weights=held * scale, minlength=len(counts))).astype(np.int64)
        top = seat(customers, np.full(len(counts), uniform), d0, outer, random)
        if sweep >= settings.burn_in:
            for into, value in zip(added, (customers - d0 * top, pair_counts - d * held, held, customers, top)):
                into += value
    word_weight, pair_weight, held_mean, customer_mean, top_mean = (a / settings.samples for a in added)
    tables = np.bincount(pair_context, weights=held_mean, minlength=len(wide))
    return Seating(word_weight, pair_weight, tables, float(customer_mean.sum()), float(top_mean.sum()), held_mean)


def counts_among(asked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, contexts, training tokens) of the pairs among the frequent words."""
    among = asked.filter("context IS NOT NULL").groupBy("context", "word").agg(F.sum("n").alias("n")).collect()  # frequent^2 at most
    among = sorted((r["word"], r["context"], r["n"]) for r in among)
    return tuple(np.array([r[k] for r in among], np.int64) for k in range(3))


def answers(asked: DataFrame, corpus: Corpus, settings: Settings, parts: int) -> DataFrame:
    """Per part: the answers to its blocks, and totals by number.

    Blocks get weights of words and pairs. With the block number ``TABLES``, tables of contexts go to the parts of these. The totals
    are the tables of the frequent words as contexts, customers and tables of the parent, and what tables of the frequent words exceed their tokens by.
    """
    among_word, among_context, among_counts = counts_among(asked)
    contexts = max(1, len(corpus.counts))

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
        sent = [unpack(data) for _, data in rows]
        by_word = len(sent[0]) == 7
        names = [sums(columns[-4]) for columns in sent]
        known = np.unique(np.concatenate(names))
        known_counts = np.zeros(len(known), np.int64)
        for own, columns in zip(names, sent):
            known_counts[np.searchsorted(known, own)] = columns[-3]
        wide = expected_tables(known_counts, settings.discount, settings.strength)
        if by_word:
            hashes = [sums(columns[0]) for columns in sent]
            words = np.unique(np.concatenate(hashes))
            places = [np.searchsorted(words, h) for h in hashes]
            counts = np.zeros(len(words), np.int64)
            for at, columns in zip(places, sent):
                counts[at] = columns[1]
            spread = [np.repeat(at, columns[2]) for at, columns in zip(places, sent)]
        else:
            spread = [columns[0].astype(np.int64) for columns in sent]
        keys = [w * len(known) + np.searchsorted(known, own)[columns[-2]] for w, own, columns in zip(spread, names, sent)]
        pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
        pair_counts = np.bincount(where, weights=np.concatenate([c[-1] for c in sent]), minlength=len(pairs)).astype(np.int64)
        pair_word, pair_context = (pairs // len(known), pairs % len(known)) if len(known) else (pairs, pairs)
        size, totals = len(pairs), np.zeros(2 * contexts + 2)
        frequent = found_at(corpus.frequent, known)
        if by_word:
            found = sample_seating(corpus, settings, counts, pair_word, pair_context, pair_counts, part, wide)
            totals[frequent[frequent >= 0]] = found.context_tables[frequent >= 0]
            totals[contexts : contexts + 2] = found.customers, found.tables
        else:  # with the pairs among the frequent words, whose tables are the same in each of these parts
            here = np.bincount(pair_word, weights=pair_counts, minlength=contexts)
            rest = corpus.counts - np.bincount(among_word, weights=among_counts, minlength=contexts)
            scale = np.concatenate([(rest / np.maximum(here, 1))[pair_word], np.ones(len(among_word))])
            every = [np.concatenate(two) for two in ((pair_word, among_word), (pair_context, len(known) + among_context), (pair_counts, among_counts))]
            wide = np.concatenate([wide, expected_tables(corpus.counts, settings.discount, settings.strength)])
            found = sample_seating(corpus, settings, corpus.counts, *every, part, wide, np.zeros(contexts, np.int64), scale)
            totals[contexts + 2 :] = np.bincount(pair_word, weights=found.pair_tables[:size] - pair_counts, minlength=contexts)
        told = np.flatnonzero((frequent < 0) & (found.context_tables[: len(known)] > 0))
        out, done = [], 0
        for to, here in by_part(known[told] >> PART_BITS, parts):
            mine = told[here]
            out.append((TABLES, to, pack([deltas(known[mine]), found.context_tables[mine].astype(np.float32)]), None, None))
        for number, (mine, (block, _)) in enumerate(zip(keys, rows)):
            here = slice(done, done + len(mine))
            done += len(mine)
            weights = [found.word_weight[places[number]] if by_word else np.zeros(0), found.pair_weight[where[here]]]
            out.append((block, part, pack([w.astype(np.float32) for w in weights]), None, None))
        out += [(None, None, None, k, v) for k, v in enumerate(totals.tolist()) if v]
        return batch_of(out, ANSWER_SCHEMA, pa.Table)

    return asked.filter(F.col("part") >= 0).select("block", "part", "payload").groupBy("part").applyInArrow(answer, ANSWER_SCHEMA)


def context_tables(counted: Counted, answered: DataFrame) -> DataFrame:
    """Per block and part, the tables of its words as contexts, in all blocks together and in the order of its sorted words."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = list(zip(table.column("block").to_pylist(), table.column("payload").to_pylist()))
        mine = {block: place_in_part(unpack(data)[0]) for block, data in rows if block != TABLES}
        tables = np.zeros(max((int(at[-1]) + 1 for at in mine.values()), default=0))
        for told, sent in (unpack(data) for block, data in rows if block == TABLES):
            tables[place_in_part(told)] += sent
        return batch_of([(block, part, pack([tables[at].astype(np.float32)])) for block, at in mine.items()], TOLD_SCHEMA, pa.Table)

    told = answered.filter(F.col("block") == TABLES).select("block", "part", "payload")
    return numbers_of(counted).union(told).groupBy("part").applyInArrow(add, TOLD_SCHEMA)


def place_in_part(differences: np.ndarray) -> np.ndarray:
    """Places of words among those of their part, from the differences of their numbers."""
    return sums(differences) & ((1 << PART_BITS) - 1)


@dataclass
class Model:
    """What every block needs: totals, and the seating of the frequent words."""

    corpus: Corpus
    settings: Settings
    tables: np.ndarray
    customers: float
    parent_tables: float
    word_weight: np.ndarray
    pair_weight: np.ndarray  # context by word

    def parent(self, weight: np.ndarray) -> np.ndarray:
        """Probability of words in the parent restaurant, from their customers less discounts."""
        c, s = self.corpus, self.settings
        return (weight + (s.strength + c.discount * self.parent_tables) / (c.types + 1)) / (s.strength + self.customers)

    def after(self, context: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability of words after contexts, from the pairs' customers less discounts and the words' parent probability."""
        return self.seated(self.tables[context], self.corpus.counts[context], weight, parent)

    def seated(self, tables: np.ndarray, customers: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """``after`` for contexts with these tables and customers."""
        s = self.settings
        return (weight + (s.strength + s.discount * tables) * parent) / (s.strength + customers)


def learn_model(asked: DataFrame, answered: DataFrame, corpus: Corpus, settings: Settings) -> Model:
    """Seat the frequent words, whose counts are a small matrix, and add up the tables of all words."""
    contexts = max(1, len(corpus.counts))
    word, context, n = counts_among(asked)
    totals = np.zeros(2 * contexts + 2)
    for r in answered.filter("context IS NOT NULL").groupBy("context").agg(F.sum("tables").alias("tables")).collect():
        totals[r["context"]] = r["tables"]
    direct = corpus.counts - np.bincount(word, weights=n, minlength=len(corpus.counts)).astype(np.int64)
    direct += np.rint(totals[contexts + 2 :]).astype(np.int64)[: len(direct)]
    found = sample_seating(corpus, settings, corpus.counts, word, context, n, 1 << 40, direct=direct)
    pairs = np.zeros((contexts, contexts))
    pairs[context, word] = found.pair_weight
    tables, (customers, parent_tables) = totals[:contexts], totals[contexts : contexts + 2]
    return Model(
        corpus, settings, tables + found.context_tables, customers + found.customers, parent_tables + found.tables, found.word_weight, pairs
    )


def scores(counted: Counted, answered: DataFrame, model: Model) -> DataFrame:
    """Bring the answers back to their blocks and add up the documents."""
    corpus, settings, parts = model.corpus, model.settings, counted.parts
    least = least_count(corpus.tokens, settings)

    def score(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))
        block = block_of(rows[0][1], [data for part, data in rows[1:] if part < parts], least)
        got = [(part, unpack(data)) for part, data in rows[1:] if part >= parts]
        together = lambda first, last, n: np.concatenate([np.zeros(0), *[g[n] for p, g in got if first * parts <= p < last * parts]])
        words, count, pair_words, pair_contexts = block.words, block.counts, block.pair_words, block.pair_contexts
        common = found_at(corpus.frequent, words)
        spots, rare = np.flatnonzero(common >= 0), np.flatnonzero((common < 0) & (count > 0))
        tables, weight = together(3, 4, 0), np.zeros(len(words))
        weight[rare] = together(1, 2, 0)
        weight[spots], tables[spots] = model.word_weight[common[spots]], model.tables[common[spots]]
        parent = model.parent(weight)
        chance = parent[block.places]
        if len(block.at):
            own, others = pair_order(common, words >> PART_BITS, pair_words, pair_contexts)
            pair = np.zeros(len(pair_words))
            pair[own], pair[others] = together(1, 2, 1), together(2, 3, 1)
            both = (common[pair_words] >= 0) & (common[pair_contexts] >= 0)
            pair[both] = model.pair_weight[common[pair_contexts[both]], common[pair_words[both]]]
            chance[block.at] = model.seated(tables[pair_contexts], count[pair_contexts], pair, parent[pair_words])[block.where]
        starts = np.cumsum(block.lengths) - block.lengths
        total = lambda values: np.add.reduceat(values, starts)  # noqa: E731  every document has a token, its end
        base = np.log10((count + 1) / (corpus.tokens + corpus.types + 1))
        columns = [
            pa.array(block.ids, pa.int64(), mask=block.known == 0),
            pa.array(block.held.astype(bool)),
            pa.array(block.lengths, pa.int64()),
            pa.array(total((count > 0)[block.places].astype(np.int64)), pa.int64()),
            pa.array(np.full(len(block.ids), corpus.tokens), pa.int64()),
            pa.array(total(base[block.places])),
            pa.array(total(np.log10(chance))),
        ]
        return pa.table(columns, names=[c.split(" ")[0] for c in SCORE_SCHEMA.split(", ")])

    moved = lambda df, by: df.select("block", (F.col("part") + by * parts).alias("part"), "payload")
    replies = moved(answered.filter(F.col("block") >= 0), 1)
    tables = moved(context_tables(counted, answered), 3)
    return counted.documents.union(numbers_of(counted)).union(replies).union(tables).groupBy("block").applyInArrow(score, SCORE_SCHEMA)


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    Null and empty texts have one token, their end. Repeated rows are trained on and scored as often as they occur;
    a null id is not held out. Without training documents all words are the unknown one, with probability 1. Scores
    are log10 probabilities; the perplexity of a text is 10 ** (-score / n_tokens).
    """
    counted = counted_blocks(docs, settings)
    corpus = learn_corpus(counted, settings)
    asked = materialise(messages(counted, corpus, settings), "messages")
    answered = materialise(answers(asked, corpus, settings, counted.parts), "answers")
    model = learn_model(asked, answered, corpus, settings)
    forget(asked)
    return scores(counted, answered, model)
