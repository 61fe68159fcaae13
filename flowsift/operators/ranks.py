"""Exact cuts in a total order without ranking the whole table.

Rows are counted per coarse bucket, the running count finds the bucket holding the wanted rank, that bucket is cut
finer until it is small, and only what is left is ranked. The full table is then compared with the cut-off row: no shuffle of full rows, and
the answer equals that of a global ``row_number``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.functions.scalars import content_digest
from flowsift.session import materialise

DIGEST_DIGITS = 3  # 4,096 md5 buckets: few enough to count cheaply in every task
RANKED_ROWS = 1_000_000  # rows that one task may rank


def bucket_counts(rows: DataFrame, bucket: str, group: str) -> DataFrame:
    """Rows per group and bucket (``_n``), stored: a few thousand rows from which totals and cuts both follow."""
    return materialise(rows.groupBy(group, bucket).agg(F.count("*").alias("_n")), "bucket_counts")


def rank_cut(
    rows: DataFrame,
    quotas: DataFrame,
    bucket: str,
    order: Sequence[str],
    group: str,
    counts: DataFrame | None = None,
    finer: Callable[[int], Column] | None = None,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Per group, the ``order`` values of the row whose rank equals the group's ``quota``.

    ``rows`` has ``group``, ``bucket`` and ``order``, where ``bucket`` never decreases along ``order``.
    ``quotas`` has one row per group with ``quota`` >= 1. Groups are classes, so there are few. The bucket that holds
    the wanted rank is counted again by ``finer(level)``, which takes the order further, until it holds no more than
    ``ranked_rows`` rows; only then are its rows ranked. Without ``finer`` the caller bounds the buckets.
    """
    counts = bucket_counts(rows, bucket, group) if counts is None else counts
    inside, wanted, level = rows, quotas.select(group, "quota"), 0
    while True:
        upto = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("_upto", F.sum("_n").over(upto)).join(wanted, group)
        boundary = running.filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        boundary = materialise(boundary.select(group, bucket, "_n", (F.col("quota") - (F.col("_upto") - F.col("_n"))).alias("_wanted")), "boundary")
        inside = inside.join(F.broadcast(boundary.select(group, bucket)), [group, bucket])  # a row per group
        level += 1
        if finer is None or level >= MAX_LEVELS or boundary.filter(F.col("_n") > ranked_rows).isEmpty():
            break
        inside = inside.withColumn(bucket, finer(level))
        counts = bucket_counts(inside, bucket, group)
        wanted = boundary.select(group, F.col("_wanted").alias("quota"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return (
        inside.withColumn("_place", place)
        .join(F.broadcast(boundary.select(group, "_wanted")), group)
        .filter(F.col("_place") == F.col("_wanted"))
        .select(group, *[F.col(c).alias(f"_cut_{c}") for c in order])
    )


MAX_LEVELS = 32 // DIGEST_DIGITS


def digest_bucket(level: int) -> Column:
    """The next digits of the digest: level 0 is the coarse bucket, each level splits it into 4,096 parts."""
    return F.substring("_digest", 1 + level * DIGEST_DIGITS, DIGEST_DIGITS)


def at_or_before(order: Sequence[str]) -> Column:
    """Whether a row comes no later than the cut-off row joined to it."""
    return F.struct(*order) <= F.struct(*[F.col(f"_cut_{c}").alias(c) for c in order])


def digest_columns(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Add the pseudo-random order of a keyed table and its bucket."""
    return df.withColumn("_digest", content_digest(key, seed)).withColumn("_bucket", digest_bucket(0))


def smallest_rows(df: DataFrame, n: int, key: Sequence[str], seed: int, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """The ``n`` rows with the smallest digest, all rows if there are no more than ``n``. ``key`` is unique."""
    marked = digest_columns(df, key, seed)
    order = ["_digest", *key]
    slim = marked.select(F.lit(0).alias("_all"), "_bucket", *order)
    counts = bucket_counts(slim, "_bucket", "_all")
    quotas = counts.groupBy("_all").agg(F.sum("_n").alias("_rows")).filter(F.col("_rows") > n)
    wanted = quotas.select("_all", F.lit(n).cast("long").alias("quota"))
    cut = rank_cut(slim, wanted, "_bucket", order, "_all", counts, digest_bucket, ranked_rows)
    last = cut.select(F.struct(*[F.col(f"_cut_{c}").alias(c) for c in order])).scalar()
    return marked.filter(F.coalesce(F.struct(*order) <= last, F.lit(True))).select(*df.columns)
