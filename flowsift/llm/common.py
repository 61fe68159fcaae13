"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.session import materialise

#: The white space that separates words: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null for a null text.

    White space becomes single blanks first: splitting at one fixed character needs no regular expression.
    """
    return F.array_remove(F.split(F.translate(text, WORD_SPACE[1:], " " * (len(WORD_SPACE) - 1)), " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def forget(stored: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote. Nothing lazy may read it any more."""
    spark = stored.sparkSession
    for file in stored.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_new(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``df`` with the added columns; input columns of the same names (in any case) are replaced."""
    names = {c.lower() for c in added}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def numbered(df: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each ``group``, in no particular order.

    The rows are stored once, which fixes their place (stored file part, row). Numbers run within (group, part),
    whose rows are bounded by the size of one task's input, and start at the rows of the parts before. So a
    group with a third of all rows, or equal rows, end up in as many tasks as they were read by.
    """
    part, place, before, local = (fresh(df, c) for c in ("_part", "_place", "_before", "_local"))
    stored = materialise(df.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    rows = stored.groupBy(*group, part).agg(F.count("*").alias(local))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select(*group, part, F.coalesce(F.sum(local).over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(*group, part).orderBy(place))
    counted = stored.withColumn(local, inside.cast("long") - 1)
    joined = counted.join(offsets, [*group, part])
    return joined.withColumn(name, F.col(local) + F.col(before)).select(*df.columns, name)


def sample_rows(rows: DataFrame, n: int, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of some columns: the same ones in every run.

    Where there are many more rows, all but about 4 ``n`` are left out by their hash before the rest is ordered, so the task
    that orders them gets a bounded number of rows, not ``n`` from every task.
    """
    order = F.xxhash64(*columns, F.lit(seed))
    total = rows.count()
    if total > 4 * n:
        rows = rows.filter(order <= int(-(2.0**63) + 2.0**64 * (4 * n / total)))
    return rows.orderBy(order, *columns).limit(n)
