"""Repeated passages by prefix-free parsing: bytes that lie in a string of 50 bytes which an earlier document holds are removed.

Texts are cut into phrases where a rolling hash of 24 bytes hits a trigger value. A phrase reaches over the next 49 bytes, so every 50-byte
string starts in exactly one phrase. Equal phrases form one entry of the dictionary, owned by the smallest doc_id: in any later document all strings of the
phrase are repeats, and only the dictionary is searched further, however often its phrases occur.

Within the dictionary, each string is anchored at the smallest of its 24-byte hashes, which equal strings share. Strings whose anchor occurs in one place
only have no equal. The contexts of the other anchors are put in suffix order to a depth of 50 bytes; neighbours that agree to that depth are
equal strings, and the order of their documents tells which are repeats. The parse, which names the phrase of each place, carries this back to all documents.

Documents are stored in blocks of some MB. Blocks and buckets of hashes talk in packed messages: a block sends each bucket its distinct entries, and gets a
bit for each. So an entry counts once a block, however often it is repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsift.session import materialise, scratch_path


@dataclass(frozen=True)
class Passages:
    """Parameters. ``span``: length of a repeated string. The others change the work, not the result."""

    span: int = 50
    gram: int = 24  # bytes under the rolling hash; any string of ``span`` bytes holds several
    phrase_bits: int = 7  # a phrase ends about every 2^bits bytes
    block_bytes: int = 4 << 20
    piece_bytes: int = 1 << 19  # a longer document is cut into pieces that overlap by span - 1 bytes
    bucket_bytes: int = 16 << 20  # text for which there is a bucket of hashes
    hot: int = 1000  # an anchor with more contexts is searched string by string
    sorted_strings: int = 1 << 20  # strings put in order at once


SLICE = 1 << 20  # bytes parsed at once; a place in a slice fits POSITION bits
POSITION = np.uint64(SLICE - 1)
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
NO_ID = -(2**63)  # the order of a null doc_id: before all others


@cache
def byte_values() -> np.ndarray:
    state = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    for _ in range(3):
        state = (state ^ (state >> np.uint64(29))) * MIX
    return state | np.uint64(1)


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (BASE, inverse))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes at each place of no more than a slice."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(SLICE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[:n], out=sums[1:])
    value = (sums[width:] - sums[:-width]) * down[: n - width + 1]
    value ^= value >> np.uint64(32)
    value *= MIX
    value ^= value >> np.uint64(29)
    return value


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def distinct_ascending(values: np.ndarray) -> np.ndarray:
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


@dataclass
class Slice:
    """Some pieces of documents, parsed together."""

    rule: Passages
    text: bytes
    sizes: np.ndarray
    keys: np.ndarray
    data: np.ndarray = field(init=False)
    offsets: np.ndarray = field(init=False)
    hashes: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.data = np.frombuffer(self.text, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def grams(self) -> np.ndarray:
        if self.hashes is None:
            self.hashes = rolling(self.data, self.rule.gram)
        return self.hashes

    def starts(self) -> np.ndarray:
        """Which places start a string inside their piece."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        counts = self.sizes - self.rule.span + 1
        some = counts > 0
        inside[self.offsets[:-1][some]] += 1
        np.subtract.at(inside, self.offsets[:-1][some] + counts[some], 1)
        return np.cumsum(inside[:-1]).astype(bool)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last place + 1 of each phrase's strings, and the order key of its document."""
        grams = self.grams()
        cut = np.flatnonzero((grams & np.uint64((1 << self.rule.phrase_bits) - 1)) == 0)
        if cut.size:  # in periodic text one trigger stands for a run of equal ones
            again = (np.diff(cut) < 1 << self.rule.phrase_bits) & (grams[cut[1:]] == grams[cut[:-1]])
            cut = cut[np.concatenate([[True], ~again])]
        counts = self.sizes - self.rule.span + 1
        pieces = np.flatnonzero(counts > 0)
        if not pieces.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end = self.offsets[pieces], self.offsets[pieces] + counts[pieces]
        at = np.searchsorted(begin, cut, side="right") - 1
        cut = cut[(at >= 0) & (cut < end[np.maximum(at, 0)])]
        first = np.unique(np.concatenate([begin, cut]))
        piece = np.searchsorted(begin, first, side="right") - 1
        last = np.minimum(np.append(first[1:], len(self.data)), end[piece])
        return first, last, self.keys[pieces[piece]]

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits for each phrase with the bytes it reaches over."""
        over, view = self.rule.span - 1, memoryview(self.text)
        found = b"".join(hashlib.blake2b(view[a : b + over], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist()))
        return np.frombuffer(found, np.uint64).reshape(-1, 2)

    def anchors(self, places: np.ndarray) -> np.ndarray:
        """The anchor of each string, the place of its smallest hash, the first of equal ones. Ascending as the places are."""
        if not places.size:
            return places
        packed = (self.grams() & ~POSITION) | np.arange(len(self.grams()), dtype=np.uint64)
        return (window_minimum(packed, self.rule.span - self.rule.gram + 1)[places] & POSITION).astype(np.int64)

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Order key of the document at each place."""
        return self.keys[np.searchsorted(self.offsets, places, side="right") - 1]


def packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed message, each led by its length."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(r).to_bytes(8, "little") + r for r in raw))


def unpacked(message: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(message), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


BLOCK_SCHEMA = pa.schema([("_block", pa.int64()), ("_whole", pa.bool_()), ("_bytes", pa.int64()), ("_data", pa.binary())])
BLOCK_TYPE = "_block long, _whole boolean, _bytes long, _data binary"


def block_row(number: int, whole: bool, rows: list[int], keys: list[int], bases: list[int], texts: list[bytes]) -> pa.RecordBatch:
    text = b"".join(texts)
    arrays = [np.array(a, np.int64) for a in (rows, keys, bases, [len(t) for t in texts])]
    return pa.RecordBatch.from_pylist([{"_block": number, "_whole": whole, "_bytes": len(text), "_data": packed(*arrays, text)}], BLOCK_SCHEMA)


def blocks_of(rule: Passages) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (doc_id, text) -> stored blocks. A long document is stored whole, and in pieces that are searched."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, row = TaskContext.get().partitionId() << 33, 0, 0
        block: tuple[list, ...] = ([], [], [], [])
        held, overlap = 0, rule.span - 1
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
                key = doc_id.as_py() if doc_id.is_valid else NO_ID
                data = text.as_py() if text.is_valid else b""
                cut = [0] if len(data) <= rule.piece_bytes + overlap else range(0, len(data) - overlap, rule.piece_bytes)
                if len(cut) > 1:
                    yield block_row(place + number, True, [place + row], [key], [0], [data])
                    number += 1
                for base in cut:
                    piece = data if len(cut) == 1 else data[base : base + rule.piece_bytes + overlap]
                    for part, value in zip(block, (place + row, key, base if len(cut) == 1 else base + 1, piece)):
                        part.append(value)
                    held += len(piece)
                    if held >= rule.block_bytes or len(block[0]) >= 1 << 16:
                        yield block_row(place + number, False, *block)
                        block, held, number = ([], [], [], []), 0, number + 1
                row += 1
        if block[0]:
            yield block_row(place + number, False, *block)

    return build


@dataclass
class Block:
    """A block read back. ``bases``: 0 for a whole document, else 1 + the piece's place in it."""

    rule: Passages
    rows: np.ndarray
    keys: np.ndarray
    bases: np.ndarray
    sizes: np.ndarray
    text: bytes

    @classmethod
    def read(cls, rule: Passages, data: bytes) -> Block:
        *arrays, text = unpacked(data)
        return cls(rule, *[np.frombuffer(a, np.int64) for a in arrays], text)

    def slices(self) -> Iterator[Slice]:
        first, at = 0, 0
        while first < len(self.sizes):
            total = np.cumsum(self.sizes[first:])
            n = max(1, int(np.searchsorted(total, SLICE, side="right")))
            size = int(total[n - 1])
            yield Slice(self.rule, self.text[at : at + size], self.sizes[first : first + n], self.keys[first : first + n])
            first, at = first + n, at + size


@dataclass
class Entries:
    """The distinct values that a block sends, in the order of their buckets, and which of them each occurrence is."""

    buckets: np.ndarray
    columns: list[np.ndarray]
    which: np.ndarray

    def messages(self) -> Iterator[tuple[int, bytes]]:
        edges = np.flatnonzero(np.diff(self.buckets)) + 1
        for a, b in zip([0, *edges], [*edges, len(self.buckets)]):
            if b > a:
                yield int(self.buckets[a]), packed(*[c[a:b] for c in self.columns])


def phrase_entries(digests: np.ndarray, keys: np.ndarray, buckets: int) -> Entries:
    """Distinct phrases with the smallest order key that the block has for them."""
    high, low = digests[:, 0], digests[:, 1]
    dealt = (high % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, low, high, dealt))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    kept = order[new]
    return Entries(dealt[kept], [high[kept], low[kept], keys[kept]], which)


def anchor_entries(hashes: np.ndarray, buckets: int) -> Entries:
    """Distinct anchor hashes, 48 bits each, with their number of contexts in the block, up to 255.

    The bucket follows from all bits. Hashes that agree in both by chance cost a search, not a wrong result.
    """
    distinct, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    dealt = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(dealt, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Entries(dealt[order], [distinct[order].view(np.uint8).reshape(-1, 8)[:, 2:], np.minimum(counts[order], 255).astype(np.uint8)], place[which])


def context_entries(texts: list[bytes], keys: np.ndarray, buckets: np.ndarray) -> Entries:
    """Distinct contexts: the first occurrence of each in the block, and its smallest order key there."""
    seen: dict[tuple[int, bytes], int] = {}
    which = np.fromiter((seen.setdefault(c, len(seen)) for c in zip(buckets.tolist(), texts)), np.int64, len(texts))
    smallest = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, keys)
    own = np.empty(len(seen), np.int64)
    own[which[::-1]] = np.arange(len(texts))[::-1]
    order = np.argsort(buckets[own], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Entries(buckets[own][order], [own[order], smallest[order]], place[which])


MESSAGE_SCHEMA = pa.schema([("_block", pa.int64()), ("_bucket", pa.int64()), ("_message", pa.binary())])
MESSAGE_TYPE = "_block long, _bucket long, _message binary"


def own_bucket(block: int) -> int:
    """The bucket of what a block keeps for its own next pass: it is handed back unread."""
    return -1 - block


def message_batch(rows: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(MESSAGE_SCHEMA.names, r)) for r in rows], MESSAGE_SCHEMA)


def replies_to(row: dict) -> tuple[bytes | None, list[bytes]]:
    """A block's own state and its buckets' replies, in the order of the buckets."""
    told = {r["_bucket"]: r["_message"] for r in row["_told"] or []}
    return told.pop(own_bucket(row["_block"]), None), [told[b] for b in sorted(told)]


def bits(replies: list[bytes]) -> np.ndarray:
    """The values of replies as one array of small numbers."""
    return np.concatenate([np.frombuffer(unpacked(r)[0], np.uint8) for r in replies]) if replies else np.zeros(0, np.uint8)


def block_pass(rule: Passages, work: Callable[[int, Block, bytes | None, list[bytes]], Iterator[tuple[int, bytes]]]):
    """Run ``work`` on each block with what it was told; it gives (bucket, message) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                state, replies = replies_to(row) if "_told" in row else (None, [])
                block = Block.read(rule, row["_data"])
                yield message_batch((row["_block"], *m) for m in work(row["_block"], block, state, replies))

    return run


def block_phrases(block: Block, buckets: int) -> tuple[list[Slice], list[tuple], Entries]:
    slices = list(block.slices())
    parse = [s.phrases() for s in slices]
    digests = [s.digests(first, last) for s, (first, last, _) in zip(slices, parse)]
    keys = np.concatenate([p[2] for p in parse]) if parse else np.zeros(0, np.int64)
    return slices, parse, phrase_entries(np.concatenate(digests), keys, buckets)


def tell_phrases(rule: Passages, buckets: int):
    """First pass: the block's phrases."""
    return block_pass(rule, lambda number, block, state, replies: block_phrases(block, buckets)[2].messages())


def judge_phrases(group: pa.Table) -> pa.Table:
    """A bucket's phrases from all blocks -> for each, whether a smaller document has it."""
    blocks, parts = group.column("_block").to_pylist(), [unpacked(m) for m in group.column("_message").to_pylist()]
    high, low = (np.concatenate([np.frombuffer(p[k], np.uint64) for p in parts]) for k in (0, 1))
    keys = np.concatenate([np.frombuffer(p[2], np.int64) for p in parts])
    order = np.lexsort((keys, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    smallest = keys[order][new][np.cumsum(new) - 1]
    later = np.empty(len(order), np.uint8)
    later[order] = keys[order] > smallest
    return reply(group, blocks, np.split(later, np.cumsum([len(p[2]) // 8 for p in parts])[:-1]))


def handing_back(judge: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """Judge a bucket of hashes; a block's own bucket goes back as it is."""
    return lambda group: group.select(MESSAGE_SCHEMA.names) if group.column("_bucket")[0].as_py() < 0 else judge(group)


def reply(group: pa.Table, blocks: list[int], values: list[np.ndarray]) -> pa.Table:
    bucket = group.column("_bucket")[0].as_py()
    return pa.Table.from_batches([message_batch((b, bucket, packed(v)) for b, v in zip(blocks, values))])


def free_places(s: Slice, first: np.ndarray, last: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Places whose strings lie in the block's dictionary phrases."""
    change = np.zeros(len(s.data) + 1, np.int64)
    change[first[~repeated]] += 1
    np.subtract.at(change, last[~repeated], 1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def tell_anchors(rule: Passages, buckets: int):
    """Second pass: which phrases repeat, and the anchors of the strings in the others."""

    def work(number: int, block: Block, state: bytes | None, replies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        slices, parse, entries = block_phrases(block, buckets)
        later = bits(replies).astype(bool)[entries.which]
        later |= np.concatenate([p[2] for p in parse]) > entries.columns[2][entries.which]
        at, free, hashes = 0, [], []
        for s, (first, last, _) in zip(slices, parse):
            places = free_places(s, first, last, later[at : at + len(first)])
            at += len(first)
            mask = np.zeros(len(s.data), bool)
            mask[places] = True
            free.append(np.packbits(mask))
            hashes.append(s.grams()[distinct_ascending(s.anchors(places))])
        yield own_bucket(number), packed(*free)
        yield from anchor_entries(np.concatenate(hashes), buckets).messages()

    return block_pass(rule, work)


def judge_anchors(hot: int):
    """A bucket's anchors from all blocks -> 0 for a single context, 1 for several, 2 for more than ``hot``."""

    def judge(group: pa.Table) -> pa.Table:
        blocks, parts = group.column("_block").to_pylist(), [unpacked(m) for m in group.column("_message").to_pylist()]
        sent = np.frombuffer(b"".join(p[0] for p in parts), np.uint8).reshape(-1, 6)
        hashes = np.zeros((len(sent), 8), np.uint8)
        hashes[:, 2:] = sent
        _, which = np.unique(hashes.view(np.uint64)[:, 0], return_inverse=True)
        total = np.bincount(which, np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts]))[which]
        found = (total > 1).astype(np.uint8) + (total > hot)
        return reply(group, blocks, np.split(found.astype(np.uint8), np.cumsum([len(p[1]) for p in parts])[:-1]))

    return judge


def run_texts(slices: list[Slice], starts: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Bytes and order keys of runs of strings, given by their first place in the block and their number."""
    texts, keys, over, base = [], [], slices[0].rule.span - 1 if slices else 0, 0
    for s in slices:
        inside = (starts >= base) & (starts < base + len(s.data))
        own = starts[inside] - base
        texts += [s.text[a : a + n + over] for a, n in zip(own.tolist(), counts[inside].tolist())]
        keys.append(s.owner(own))
        base += len(s.data)
    return texts, np.concatenate(keys) if keys else np.zeros(0, np.int64)


def tell_contexts(rule: Passages, buckets: int):
    """Third pass: the contexts of anchors that occur again. Those of hot anchors go string by string, to a bucket of the string."""

    def work(number: int, block: Block, state: bytes | None, replies: list[bytes]) -> Iterator[tuple[int, bytes]]:
        slices = list(block.slices())
        free = [np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), count=len(s.data))) for s, m in zip(slices, unpacked(state))]
        anchors = [s.anchors(places) for s, places in zip(slices, free)]
        distinct = [distinct_ascending(a) for a in anchors]
        hashes = [s.grams()[d] for s, d in zip(slices, distinct)]
        entries = anchor_entries(np.concatenate(hashes), buckets)
        status = bits(replies)[entries.which] if len(entries.which) else np.zeros(0, np.uint8)
        at, base, starts, counts, dealt = 0, 0, [], [], []
        for s, places, own, anchor, found in zip(slices, free, anchors, distinct, hashes):
            kind = status[at : at + len(anchor)][np.searchsorted(anchor, own)]
            at += len(anchor)
            kept = kind > 0
            places, own, kind = places[kept], own[kept], kind[kept]
            new = np.ones(len(places), bool)
            new[1:] = (np.diff(places) != 1) | (own[1:] != own[:-1]) | (kind[1:] == 2)
            first = np.flatnonzero(new)
            counts.append(np.diff(np.append(first, len(places))))
            starts.append(places[first] + base)
            bucket = (found[np.searchsorted(anchor, own[first])] % np.uint64(buckets)).astype(np.int64)
            for k in np.flatnonzero(kind[first] == 2).tolist():
                a = int(places[first[k]])
                bucket[k] = zlib.crc32(s.text[a : a + rule.span]) % buckets
            dealt.append(bucket)
            base += len(s.data)
        runs = [np.concatenate(x).astype(np.int64) for x in (starts, counts, dealt)]
        yield own_bucket(number), packed(state, *runs)
        texts, keys = run_texts(slices, runs[0], runs[1])
        for bucket, data in context_messages(texts, keys, runs[2]):
            yield bucket, data

    return block_pass(rule, work)


def context_messages(texts: list[bytes], keys: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    entries = context_entries(texts, keys, buckets)
    edges = np.flatnonzero(np.diff(entries.buckets)) + 1
    for a, b in zip([0, *edges], [*edges, len(entries.buckets)]):
        if b > a:
            own = [texts[k] for k in entries.columns[0][a:b]]
            yield int(entries.buckets[a]), packed(entries.columns[1][a:b], np.array([len(t) for t in own], np.int64), b"".join(own))


def hashes_at(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The rolling hash at ascending places, computed a slice at a time."""
    step = SLICE - width + 1
    edges = np.searchsorted(places, np.arange(0, len(data) + step, step))
    parts = [rolling(data[k * step : k * step + SLICE], width)[places[a:b] - k * step] for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def repeated_strings(data: np.ndarray, places: np.ndarray, keys: np.ndarray, span: int, at_once: int) -> np.ndarray:
    """Which of the strings at some places of ``data`` also stand at a place with a smaller key.

    The places are put in suffix order to the depth of a string, a share at a time: equal strings fall into one share.
    """
    later, hashes = np.zeros(len(places), bool), hashes_at(data, places, span)
    shares = max(1, -(-len(places) // at_once))
    views = np.lib.stride_tricks.sliding_window_view(data, span) if len(data) >= span else None
    for share in range(shares):
        some = np.flatnonzero(hashes % np.uint64(shares) == share)
        if not some.size:
            continue
        strings = np.ascontiguousarray(views[places[some]])
        deep = np.zeros((len(some), -(-span // 8) * 8), np.uint8)
        deep[:, :span] = strings
        words = deep.view(">u8")  # big-endian words compare as bytes do
        order = np.argsort(words[:, 0], kind="stable")
        equal = words[order][1:, 0] == words[order][:-1, 0]
        tied = np.zeros(len(order), bool)
        tied[1:] |= equal
        tied[:-1] |= equal
        order = order[tied]  # the others differ from their neighbours within eight bytes
        order = order[np.lexsort((keys[some][order], *[words[order, k] for k in range(words.shape[1] - 1, -1, -1)]))]
        new = np.ones(len(order), bool)
        new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
        if order.size:
            smallest = keys[some][order][new][np.cumsum(new) - 1]
            later[some[order]] = keys[some][order] > smallest
    return later


def judge_contexts(span: int, at_once: int):
    """A bucket's contexts from all blocks -> for each string, whether a smaller document has it."""

    def judge(group: pa.Table) -> pa.Table:
        blocks, parts = group.column("_block").to_pylist(), [unpacked(m) for m in group.column("_message").to_pylist()]
        keys = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
        sizes = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        counts = sizes - span + 1
        offsets = np.cumsum(sizes) - sizes
        ends = np.cumsum(counts)
        places = np.repeat(offsets - (ends - counts), counts) + np.arange(int(ends[-1]))
        later = repeated_strings(data, places, np.repeat(keys, counts), span, at_once).astype(np.uint8)
        of_part = [int((np.frombuffer(p[1], np.int64) - span + 1).sum()) for p in parts]
        return reply(group, blocks, np.split(later, np.cumsum(of_part)[:-1]))

    return judge


DONE_SCHEMA = pa.schema(
    [("_row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("_ranges", pa.list_(pa.int64()))]
)
DONE_TYPE = "_row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, _ranges array<long>"


def removed_runs(places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the strings at ascending places."""
    if not places.size:
        return places, places
    gap = np.flatnonzero(np.diff(places) > span)
    return places[np.concatenate([[0], gap + 1])], places[np.append(gap, len(places) - 1)] + span


def cut_document(data: bytes, first: np.ndarray, last: np.ndarray) -> dict:
    """Counts and digest of a text without some runs."""
    kept, at = hashlib.sha256(), 0
    view = memoryview(data)
    for a, b in zip(first.tolist(), last.tolist()):
        kept.update(view[at:a])
        at = b
    kept.update(view[at:])
    return {"n_bytes": len(data), "n_removed": int((last - first).sum()), "n_spans": len(first), "kept_sha256": kept.hexdigest()}


def finish(rule: Passages):
    """Last pass: every document without its repeats. A piece of a long document only names its runs, as first, last, first, last."""

    def repeats(block: Block, state: bytes, replies: list[bytes]) -> np.ndarray:
        free_bits, starts, counts, dealt = unpacked(state)
        starts, counts, dealt = (np.frombuffer(x, np.int64) for x in (starts, counts, dealt))
        slices = list(block.slices())
        places = []
        base = 0
        for s, m in zip(slices, unpacked(free_bits)):
            places.append(np.flatnonzero(s.starts() & ~np.unpackbits(np.frombuffer(m, np.uint8), count=len(s.data)).astype(bool)) + base)
            base += len(s.data)
        if len(starts):
            texts, keys = run_texts(slices, starts, counts)
            entries = context_entries(texts, keys, dealt)
            own = entries.columns[0]
            of_entry = counts[own]
            ends = np.cumsum(of_entry)
            told = bits(replies).astype(bool)
            where = np.repeat((ends - of_entry)[entries.which] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            later = told[where] | np.repeat(keys > entries.columns[1][entries.which], counts)
            strings = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            places.append(strings[later])
        return np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                state, replies = replies_to(row)
                block, out = Block.read(rule, row["_data"]), []
                places = repeats(block, state, replies)
                offsets = np.concatenate([[0], np.cumsum(block.sizes)])
                edges = np.searchsorted(places, offsets)
                for k, (doc, key, base) in enumerate(zip(block.rows.tolist(), block.keys.tolist(), block.bases.tolist())):
                    first, last = removed_runs(places[edges[k] : edges[k + 1]] - offsets[k], rule.span)
                    found = {"_row": doc, "doc_id": None if key == NO_ID else key}
                    if base:
                        out.append(found | {"_ranges": np.stack([first, last], axis=1).ravel() + (base - 1)})
                    else:
                        out.append(found | cut_document(block.text[offsets[k] : offsets[k + 1]], first, last))
                yield pa.RecordBatch.from_pylist(out, DONE_SCHEMA)

    return run


def finish_long(rule: Passages):
    """Whole long documents with the runs of their pieces, which may overlap or meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                block = Block.read(rule, row["_data"])
                runs = np.array([x for part in row["_parts"] or [] for x in part], np.int64).reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(runs[:, 1]) if len(runs) else runs[:, 1]
                new = np.ones(len(runs), bool)
                new[1:] = runs[1:, 0] > reach[:-1]
                heads = np.flatnonzero(new)
                first, last = runs[heads, 0], reach[np.append(heads[1:], len(runs)) - 1] if len(runs) else reach
                key = int(block.keys[0])
                found = {"_row": int(block.rows[0]), "doc_id": None if key == NO_ID else key}
                yield pa.RecordBatch.from_pylist([found | cut_document(block.text, first, last)], DONE_SCHEMA)

    return run


def stored_by_block(blocks: DataFrame, parts: int) -> DataFrame:
    """The blocks in a table bucketed by their number, so that the passes that bring them replies need not move them."""
    spark, path = blocks.sparkSession, scratch_path(blocks.sparkSession, "blocks")
    name = "passages_" + path.split("/")[-2]
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer, Spark would deal the table out again
    blocks.repartition(parts, "_block").write.bucketBy(parts, "_block").option("path", path).saveAsTable(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, rule: Passages = Passages()) -> DataFrame:
    """Documents (doc_id, text) without the bytes that repeat a string of ``rule.span`` bytes of a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each input row. Texts are UTF-8 bytes; a null text is empty, texts shorter
    than a string keep all. A null doc_id comes before all others. Rows of equal doc_id do not take from each other. Other columns take no part.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // rule.bucket_bytes))
    blocks = stored_by_block(slim.mapInArrow(blocks_of(rule), BLOCK_TYPE), buckets)
    searched = blocks.filter("not _whole").select("_block", "_data")

    def told(messages: DataFrame) -> DataFrame:
        each = messages.groupBy("_block").agg(F.collect_list(F.struct("_bucket", "_message")).alias("_told"))
        return searched.join(each.hint("shuffle_hash"), "_block", "left")

    def judged(messages: DataFrame, judge) -> DataFrame:
        return messages.groupBy("_bucket").applyInArrow(handing_back(judge), MESSAGE_TYPE)

    phrases = searched.mapInArrow(tell_phrases(rule, buckets), MESSAGE_TYPE)
    anchors = told(judged(phrases, judge_phrases)).mapInArrow(tell_anchors(rule, buckets), MESSAGE_TYPE)
    contexts = told(judged(anchors, judge_anchors(rule.hot))).mapInArrow(tell_contexts(rule, buckets), MESSAGE_TYPE)
    done = materialise(told(judged(contexts, judge_contexts(rule.span, rule.sorted_strings))).mapInArrow(finish(rule), DONE_TYPE), "done")
    pieces = done.filter("n_bytes is null").groupBy("_row").agg(F.collect_list("_ranges").alias("_parts"))
    whole = blocks.filter("_whole").mapInArrow(whole_rows(rule), "_row long, _data binary")
    long = whole.join(pieces, "_row", "left").mapInArrow(finish_long(rule), DONE_TYPE)
    return done.filter("n_bytes is not null").unionAll(long).drop("_row", "_ranges")


def whole_rows(rule: Passages):
    """Whole long documents with their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("_data").to_pylist():
                row = int(Block.read(rule, data).rows[0])
                yield pa.RecordBatch.from_pylist([{"_row": row, "_data": data}], pa.schema([("_row", pa.int64()), ("_data", pa.binary())]))

    return run
