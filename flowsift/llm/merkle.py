"""Merkle manifest of a table: one digest per row, a tree per group and a root, with a proof and a folded check per row.

Nodes are numbered within their group by range partitions, and 512 consecutive ones form a block: three levels of runs of
eight. A round reduces every block to one node, so a group of n rows takes log512(n) rounds, whatever the group's
share of the table. The proofs come down the same way: a block learns the path of its own node, and hands each member
the three steps inside the block followed by that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from flowsift.llm.common import ascii_lower
from flowsift.session import materialise

FAN_OUT = 8
BLOCK_LEVELS = 3
BLOCK = FAN_OUT**BLOCK_LEVELS


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_text(value: Column) -> Column:
    """A field as a leaf holds it: its UTF-8 length, a colon and the value, or a dash for null."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]).cast("binary"), 256)


@dataclass
class Parent:
    """A node with its children and, for each slot, the hash state that has taken in the children before it."""

    children: list[str]

    def __post_init__(self) -> None:
        state = hashlib.sha256()
        self.before = []
        for child in self.children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, value: str) -> str:
        """The digest with another child in ``slot``: the children before it are not hashed again."""
        return resumed(self.before[slot], value, "".join(self.children[slot + 1 :]))

    def siblings(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])


def resumed(before, value: str, after: str) -> str:
    """Go on from a kept hash state with a child and what stands right of it."""
    state = before.copy()
    state.update(value.encode())
    state.update(after.encode())
    return state.hexdigest()


def block_levels(leaves: list[str], total: int) -> list[list[Parent]]:
    """The levels of parents over a block, the lowest first. ``total``: nodes of the whole group, of which these are some.

    A group with a single node has no level. A block of a larger group gets all its levels, even over one node.
    """
    levels, nodes = [], leaves
    while total > 1 and len(levels) < BLOCK_LEVELS:
        levels.append([Parent(nodes[k : k + FAN_OUT]) for k in range(0, len(nodes), FAN_OUT)])
        nodes, total = [p.digest for p in levels[-1]], -(-total // FAN_OUT)
    return levels


@arrow_udf(StringType())
def block_root(nodes: pa.Array, total: pa.Array) -> pa.Array:
    """The digest of the node over each block."""
    out = []
    for leaves, n in zip(nodes.to_pylist(), total.to_pylist()):
        levels = block_levels(leaves, n)
        out.append(levels[-1][0].digest if levels else leaves[0])
    return pa.array(out, pa.string())


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the rows of each ``_g`` from 0 along ``order`` (``_idx``), and count them (``_total``).

    Rows are dealt out by ranges of (group, order) and stored sorted, so the rows of a group are consecutive in each stored part.
    A row's number is its distance from the part's first row of its group, and the rows of earlier parts. ``order``
    must tell all rows apart, so that many equal keys still divide into ranges.
    """
    ranged = rows.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    stored = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = stored.groupBy("_g", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_g")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_g", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_total")
    )
    placed = stored.withColumn("_part", part).join(starts, ["_g", "_part"])
    return placed.withColumn("_idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def gathered(nodes: DataFrame) -> DataFrame:
    """One stored row per block: its members in order, and the digest above them. At most ``BLOCK`` rows meet in a group."""
    values = [c for c in nodes.columns if c not in ("_g", "_total")]
    ordered = F.array_sort(F.collect_list(F.struct("_idx", *[c for c in values if c != "_idx"])))
    blocks = nodes.groupBy("_g", F.floor(F.col("_idx") / BLOCK).cast("long").alias("_block")).agg(
        ordered.alias("_members"), F.first("_total").alias("_total")
    )
    return materialise(blocks.withColumn("_digest", block_root("_members._digest", "_total")), "blocks")


@dataclass
class Forest:
    """The blocks of every round, the first over the rows themselves, and the root of each group (``_g``, ``_root``)."""

    rounds: list[DataFrame]
    roots: DataFrame


def grown(nodes: DataFrame) -> Forest:
    """Trees over nodes (``_g``, ``_idx``, ``_total``, ``_digest`` and more): rounds until every group has one node."""
    rounds, left = [], nodes
    while True:
        rounds.append(gathered(left))
        left = rounds[-1].select("_g", F.col("_block").alias("_idx"), F.expr(f"_total div {BLOCK} + int(_total % {BLOCK} > 0)").alias("_total"), "_digest")
        if left.filter("_total > 1").isEmpty():
            return Forest(rounds, left.select("_g", F.col("_digest").alias("_root")))


STEPS = [pa.field("_left", pa.list_(pa.string())), pa.field("_right", pa.list_(pa.string()))]


def member_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path of their own node -> each member's path: its siblings left and right, level by level."""
    for batch in batches:
        rows = []
        for b in batch.to_pylist():
            levels = block_levels([m["_digest"] for m in b["_members"]], b["_total"])
            for place, member in enumerate(b["_members"]):
                steps, at = [], place
                for parents in levels:
                    steps.append(parents[at // FAN_OUT].siblings(at % FAN_OUT))
                    at //= FAN_OUT
                rows.append(
                    {"_g": b["_g"], "_idx": member["_idx"], "_left": [s[0] for s in steps] + b["_left"], "_right": [s[1] for s in steps] + b["_right"]}
                )
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("_g", pa.string()), ("_idx", pa.int64()), *STEPS]))


def folded_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with the path of their own node -> each row's proof and the root folded from its ``_seen`` digest."""
    schema = pa.schema([("_key", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])
    for batch in batches:
        rows = []
        for b in batch.to_pylist():
            members = b["_members"]
            levels = block_levels([m["_digest"] for m in members], b["_total"])
            above = [(hashlib.sha256(left.encode()), right) for left, right in zip(b["_left"], b["_right"])]
            upper = "".join(left + right for left, right in zip(b["_left"], b["_right"])).encode()
            for place, member in enumerate(members):
                value, at, proof = member["_seen"], place, hashlib.sha256()
                for parents in levels:
                    parent, slot = parents[at // FAN_OUT], at % FAN_OUT
                    proof.update("".join(parent.siblings(slot)).encode())
                    value, at = parent.folded(slot, value), at // FAN_OUT
                proof.update(upper)
                for before, after in above:
                    value = resumed(before, value, after)
                rows.append(
                    {"_key": member["_key"], "leaf": member["_digest"], "subroot": b["_subroot"], "root": b["_root"], "proof_sha256": proof.hexdigest(), "folded_root": value}
                )
        yield pa.RecordBatch.from_pylist(rows, schema)


def paths_of(forest: Forest, top: DataFrame) -> DataFrame:
    """The path of every block of the first round, from the paths of the groups' roots (``_g``, ``_left``, ``_right``)."""
    paths = top.select("_g", F.lit(0).cast("long").alias("_idx"), "_left", "_right")
    for blocks in reversed(forest.rounds[1:]):
        own = blocks.select("_g", F.col("_block").alias("_idx"), "_members", "_total").join(paths, ["_g", "_idx"])
        paths = own.select("_g", "_members", "_total", "_left", "_right").mapInArrow(
            member_paths, "_g string, _idx long, _left array<string>, _right array<string>"
        )
    return paths


def sealed(rows: DataFrame) -> DataFrame:
    """The manifest of rows given as ``_key`` (long), ``_group`` (string), ``_digest`` and ``_seen``, the digest to be verified.

    Per group, leaves ascend by ``_key`` (nulls first; equal keys by digest). Group roots, ascending by the group's UTF-8
    bytes, null first, are leaves of the upper tree. Returns ``_key``, leaf, subroot, root, proof_sha256, folded_root and verified.
    No rows: an empty manifest.
    """
    named = rows.withColumn("_g", F.coalesce(F.concat(F.lit("="), "_group"), F.lit(""))).drop("_group")
    told = materialise(named.withColumn("_row", F.monotonically_increasing_id()), "leaves")  # the digests are computed once
    forest = grown(in_order(told, ["_key", "_digest", "_row"]).drop("_row"))
    subroots = forest.roots.select(F.lit("").alias("_g"), F.col("_g").alias("_group"), F.col("_root").alias("_digest"))
    top = grown(in_order(subroots, ["_group"]))
    ground = top.rounds[0].select("_g", F.col("_block").alias("_idx"), "_members", "_total")
    start = top.roots.select("_g", F.array().cast("array<string>").alias("_left"), F.array().cast("array<string>").alias("_right"))
    above = ground.join(paths_of(top, start), ["_g", "_idx"]).mapInArrow(member_paths, "_g string, _idx long, _left array<string>, _right array<string>")
    members = top.rounds[0].select(F.explode("_members").alias("m")).select("m._idx", F.col("m._group").alias("_group"), F.col("m._digest").alias("_subroot"))
    groups = members.join(above.select("_idx", "_left", "_right"), "_idx").withColumnRenamed("_group", "_g")
    groups = materialise(groups.crossJoin(F.broadcast(top.roots.select("_root"))).drop("_idx"), "groups")  # the one root
    blocks = forest.rounds[0].select("_g", F.col("_block").alias("_idx"), "_members", "_total")
    placed = blocks.join(paths_of(forest, groups), ["_g", "_idx"]).join(groups.select("_g", "_subroot", "_root"), "_g")
    out = placed.mapInArrow(
        folded_members, "_key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def seal_documents(docs: DataFrame) -> DataFrame:
    """Manifest of documents by language, verified against copies in which every third text is lower-cased.

    A leaf is the digest of doc_id, source, lang, n_chars and text; nulls are leaves' dashes. Where 3 divides the checksum of
    doc_id, the verified copy has its A-Z lower-cased; a null doc_id has no checksum and is never tampered with. Null or unchanged
    texts verify. Repeated rows are leaves of their own. Other columns take no part. Texts are hashed in the scan and never shuffled.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_digest([*fields, text])
    seen = F.when(tampered, leaf_digest([*fields, ascii_lower(text)])).otherwise(leaf)
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), F.col("lang").alias("_group"), leaf.alias("_digest"), seen.alias("_seen"))
    return sealed(rows).withColumnRenamed("_key", "doc_id")
