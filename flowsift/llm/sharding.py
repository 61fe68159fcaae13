"""Shards by jump consistent hashing: the shard follows from the key and the number of shards alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from flowsift.llm.common import numbered, text_of, with_new

#: Fixed values of the published algorithm: the step of its generator and the range of its draws.
STEP = np.uint64(2862933555777941757)
DRAWS = float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys jump at once, those that have left the range drop out."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    landing = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while moving.size:
        shard[moving] = landing[moving]
        state[moving] = state[moving] * STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        landing[moving] = ((shard[moving] + 1) * (DRAWS / draw)).astype(np.int64)
        moving = moving[landing[moving] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    @arrow_udf("int")
    def jump(keys: pa.Array) -> pa.Array:
        plain = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array(jump_hash(plain.view(np.uint64), shards), pa.int32())

    return jump(key)


def shard_rows(df: DataFrame, keys: Sequence[str], shards: int) -> DataFrame:
    """Add ``shard`` for ``shards`` shards and ``grown_shard`` for one more.

    Both follow from the key columns: equal keys share a shard, also over tables and runs. From ``shards`` to
    ``shards`` + 1, a row stays or moves into the new shard. Null keys are hashed like any value, so null rows
    are in one shard together; an empty table stays empty; input columns ``shard`` and ``grown_shard`` are
    replaced. Nothing is shuffled.
    """
    key = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    return with_new(df, {"shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1)})


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Manifest of the shards of documents: where each goes, its size and its place in the shard.

    Columns: doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot, grown_shard. A null text has size 8
    and the checksum of the empty text. Repeated rows share a shard and have slots of their own. Texts are
    reduced to size and checksum in the scan and never shuffled.
    """
    text = text_of()
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = shard_rows(slim, ["doc_id"], shards)
    return numbered(sharded, ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
