"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import text_of
from flowsift.llm.tokens import text_encoder
from flowsift.session import materialise

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long"

#: Pieces that one task packs. Its memory is a few dozen bytes for each, and every group wastes about one sequence.
GROUP_PIECES = 200_000


class OpenBins:
    """Open bins by remaining capacity. A segment tree over the capacities tells which are present.

    A node counts the open bins below it, so the smallest capacity that holds a piece is found by one walk up
    and one walk down.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()  # more leaves than capacities: the last stays empty
        self.open = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def tightest(self, need: int) -> int:
        """Smallest remaining capacity of ``need`` or more with an open bin, else -1."""
        node, tree = self.leaves + need, self.open
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.leaves:
                node *= 2
                if not tree[node]:
                    node += 1
        return node - self.leaves

    def _count(self, room: int, by: int) -> None:
        node, tree = self.leaves + room, self.open
        while node:
            tree[node] += by
            node >>= 1

    def place(self, need: int) -> tuple[int, int]:
        """Bin and offset for a piece; opens a bin if none has room."""
        room = self.tightest(need)
        if room < 0:
            number, room = self.bins, self.capacity
            self.bins += 1
        else:
            number = self.stacks[room].pop()
            self._count(room, -1)
        if room > need:
            self.stacks[room - need].append(number)
            self._count(room - need, 1)
        return number, self.capacity - room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first, each in the fullest bin that holds it."""
    bins, numbers, offsets = OpenBins(capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        numbers[i], offsets[i] = bins.place(int(lengths[i]))
    return numbers, offsets


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: only the first may be shorter than the capacity."""
    first = total - (math.ceil(total / capacity) - 1) * capacity
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)]


def document_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids_crc32. A null or empty text has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py()), end])
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length])))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces of ``PIECE_SCHEMA``.

    Pieces are dealt evenly, whatever their keys, to as many groups as their number asks for; each group is packed by
    best-fit decreasing, so the loss against one packing of everything is at most a part of a sequence per group.
    Dealing is repeatable, so a task run again gives the same numbers. Equal lengths are packed in stored order;
    no piece may be longer than the capacity.
    """
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        numbers, offsets = best_fit(table.column("length").to_numpy(), capacity)
        numbers += TaskContext.get().partitionId() << 40  # bins of one group are far fewer
        yield from table.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets)).to_batches(50_000)

    return pieces.repartition(groups).mapInArrow(pack, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, capacity: int, tokenizer: str, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Documents packed into sequences of ``capacity`` tokens, one row per piece.

    Texts are tokenised where they are read; only the description of each piece is stored and shuffled. Repeated rows
    are packed as often as they occur, null ids are kept, other columns are dropped, an empty table gives no rows.
    """
    return pack_pieces(materialise(document_pieces(docs, capacity, tokenizer)), capacity, group_pieces)
