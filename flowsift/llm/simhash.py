"""Near-duplicates by SimHash fingerprints and a covering family of bit masks.

A covering family of radius r has 2^(r+1) - 1 masks. Every bit of the fingerprint is given a non-zero vector of r + 1
bits, and mask v keeps the bits whose vector has an odd product with v. Up to r differing bits span less than the
whole space of vectors, so some v is orthogonal to them all: its mask keeps none of the differing bits, and the two
fingerprints agree under it. Every pair within the radius thus meets in some table, with certainty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowsift.llm.common import ascii_lower, fresh, text_of, words_of
from flowsift.llm.components import components
from flowsift.session import materialise

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 3

#: A bucket with more distinct fingerprints is split by a second family over the bits that its mask leaves free.
BUCKET = 2048

#: Ones in each byte, and the bits of each byte from the lowest.
BYTE_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def covering_masks(places: list[int], radius: int) -> list[int]:
    """Masks over the given bit places such that any ``radius`` of the places are outside one of them."""
    size = 1 << (radius + 1)
    vectors = [1 + k % (size - 1) for k in range(len(places))]
    return [sum(1 << p for p, m in zip(places, vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def free_places(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


def signed(value: int) -> int:
    """An unsigned 64-bit integer as the signed one of the same bits."""
    return value - (1 << BITS) if value >> (BITS - 1) else value


def shingle_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of every shingle of three words; of all words if there are fewer; none without a word."""
    hashes = lambda words: F.when(
        F.size(words) > SHINGLE_WORDS,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS),
            lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE_WORDS)])),
        ),
    ).otherwise(F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.expr("array()").cast("array<bigint>")))
    return F.get(F.transform(F.array(words_of(ascii_lower(text))), hashes), F.lit(0))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes."""
    octets = hashes.astype("<i8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def majority_bits(hashes: pa.Array) -> pa.Array:
    """Fingerprint of each list of hashes, zero for an empty one."""
    values = hashes.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    rows = [fingerprint_of(values[a:b]) if b > a else 0 for a, b in zip([0, *ends], ends)]
    return pa.array(rows, pa.int64())


def fingerprints(df: DataFrame, name: str = "fp", column: str = "text") -> DataFrame:
    """The table with its text replaced by the fingerprint, a signed long. Null texts and texts without a word have zero.

    Shingles are hashed by Spark; only the hashes go to Python, to be counted bit by bit.
    """
    keys = [c for c in df.columns if c != column]
    schema = StructType([df.schema[k] for k in keys] + [StructField(name, LongType())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[:-1], majority_bits(batch.column(len(keys)))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.select(*keys, shingle_hashes(text_of(column)).alias(name)).mapInArrow(reduce, schema)


def _links_of(values: np.ndarray) -> np.ndarray:
    """Pairs (smaller, larger) that join the distinct fingerprints of one bucket into its classes: a spanning forest.

    Pairs within the radius are found by comparing row with row in blocks; each class is grown from its first member, so at
    most one link per member is returned, not one per pair.
    """
    bits = values.view(np.uint64)
    left, links = np.arange(len(bits)), []
    while left.size:
        front, left = left[:1], left[1:]
        while front.size and left.size:
            reached = np.zeros(left.size, dtype=bool)
            for i in front:
                near = ~reached & (np.bitwise_count(bits[left] ^ bits[i]) <= RADIUS)
                links += [(values[i], values[j]) for j in left[near]]
                reached |= near
            front, left = left[reached], left[~reached]
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (bucket, fingerprint) that arrive sorted by bucket. Holds one batch and one unfinished bucket."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        buckets, values = (table.column(k).to_numpy() for k in (0, 1))
        edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
        sizes = np.diff(edges)
        pairs = [_pair_links(values, edges[:-1][sizes == 2])]
        pairs += [_links_of(np.unique(values[a : a + n])) for a, n in zip(edges[:-1][sizes > 2], sizes[sizes > 2])]
        found = np.concatenate(pairs)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        buckets = batch.column(0).to_numpy()
        cut = int(np.searchsorted(buckets == buckets[-1], True))  # first row of the last bucket
        if cut == 0:
            if held[0].column(0)[0].as_py() == buckets[-1]:
                continue
            yield from out(pa.Table.from_batches(held[:-1]))
            held = held[-1:]
        else:
            yield from out(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
    if held:
        yield from out(pa.Table.from_batches(held))


def _pair_links(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The buckets of two, all at once: rows ``at`` and the next."""
    pairs = np.stack([values[at], values[at + 1]], axis=1)
    return pairs[np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= RADIUS]


def _bucketed(rows: DataFrame, masks: list[int], salt: Column) -> DataFrame:
    """Each fingerprint once per mask, with the bucket it falls into: a hash of the salt, the mask and the kept bits."""
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(signed(m)).alias("m")) for k, m in enumerate(masks)])
    spread = rows.select("*", F.explode(tables).alias("t"))
    return spread.select("fp", F.col("t.k").alias("k"), F.xxhash64(salt, "t.k", F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket"))


def _linked(buckets: DataFrame) -> DataFrame:
    """Links within the radius in each bucket of rows (bucket, fp)."""
    placed = buckets.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_link_sorted, "a long, b long")


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) within the radius of each other, directly or not.

    Buckets are counted first. Those with more than ``BUCKET`` fingerprints are dealt out again by a second
    family, over the bits that the bucket's mask leaves free: pairs within the radius still meet, and a second bucket
    has at most 2^16 fingerprints, whatever the data, as no more bits can differ in it. No bucket is cut or skipped.
    """
    masks = covering_masks(list(range(BITS)), RADIUS)
    first = _bucketed(distinct, masks, F.lit(0))
    crowded = materialise(first.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("bucket"), "crowded")
    plain = _linked(first.join(crowded, "bucket", "left_anti"))
    inner = [[signed(m | outer) for m in covering_masks(free_places(outer), RADIUS)] for outer in masks]
    again = first.join(crowded, "bucket", "left_semi").withColumn(
        "m", F.explode(F.get(F.array(*[F.array(*[F.lit(m) for m in row]) for row in inner]), F.col("k")))
    )
    second = again.select("fp", F.xxhash64("bucket", "m", F.col("fp").bitwiseAND(F.col("m"))).alias("bucket"))
    return plain.union(_linked(second))


def classes(hashed: DataFrame, key: str) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint ``fp``, the smallest ``key`` among all rows connected to it."""
    distinct = materialise(hashed.groupBy("fp").agg(F.min(key).alias("low")), "fingerprints")
    roots = components(near_links(distinct.select("fp")))
    tied = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    return tied.join(lows, "root").select("fp", "component_id")


def simhash_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per document.

    Texts are reduced to fingerprints in one scan. Equal fingerprints are one row from then on, so thousands of copies
    cost no more than one; documents meet their class again by a plain join on the fingerprint, which Spark splits where
    one fingerprint has a third of the rows. Null and empty texts have fingerprint zero and are linked like
    any other; null ids are kept but name no class unless all ids of it are null.
    """
    hashed = materialise(fingerprints(docs.select("doc_id", "text")), "hashed")
    joined = hashed.join(classes(hashed, "doc_id"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents with one of each class of near-duplicates left: the one with the smallest key.

    Decisions are made on keys, text hashes and fingerprints alone; the texts meet those that have lost in one join. Of
    rows with the same key and text one stays. A null key is the smallest one. The columns are those of the input.
    """
    digest = fresh(docs, "_digest")
    marked = docs.withColumn(digest, F.xxhash64(text_of()))
    slim = marked.select(F.struct(F.col(f"`{key}`").alias("key"), F.col(digest).alias("digest")).alias("row"), text_of().alias("text"))
    hashed = materialise(fingerprints(slim), "hashed")
    known = hashed.join(classes(hashed, "row"), "fp")
    lost = materialise(known.filter(~F.col("row").eqNullSafe(F.col("component_id"))).select("row").distinct(), "lost")
    same = lambda rows: marked[f"`{key}`"].eqNullSafe(rows["row.key"]) & (marked[digest] == rows["row.digest"])
    winners = marked.join(lost, same(lost), "left_anti")
    repeated = materialise(hashed.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row"), "repeated")
    if not repeated.isEmpty():
        single = winners.join(repeated, same(repeated), "left_anti")
        copies = winners.join(repeated, same(repeated), "left_semi").dropDuplicates([key, digest])
        winners = single.union(copies)
    return winners.drop(digest)
