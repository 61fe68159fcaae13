"""Daily CSV sources whose headers drift, merged into one all-text table.

A source is an entry ``<day>.csv`` at any depth of the landing folder: one file, or a folder of part files with one
header. It is named by its path below the folder, so equal file names in different folders are different sources.
Sources with the same header share one scan, so the plan grows with the number of distinct headers, not of files.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowsift.functions.scalars import missing_to_null
from flowsift.operators.profile import quoted
from flowsift.schema import PROVENANCE, SOURCE_DAY

ENTRY_PATTERN = r"^(.+?)\.csv(?:/.*)?$"
HEADER_READERS = 16
CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"'}


@dataclass(frozen=True)
class Source:
    """An entry of the landing folder ``root``; ``name`` is its path below it, without the suffix."""

    name: str
    path: str
    first_file: str
    header: tuple[str, ...]
    root: str

    @property
    def columns(self) -> list[str]:
        return [c.strip() for c in self.header]


def root_of(spark: SparkSession, folder: str) -> str:
    """The folder as Spark lists it, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def below(path: Column, root: str) -> Column:
    """A listed path relative to the folder; schemes are written with one slash or three."""
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root)
    return F.substring(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), len(bare) + 2, 1 << 16)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every CSV file below the folder with its source and size; contents are not read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv").load(folder)
    place = below(F.col("path"), root_of(spark, folder))
    return files.select(
        F.regexp_extract(place, ENTRY_PATTERN, 1).alias("source"), "path", F.col("length").alias("bytes")
    ).orderBy("path")


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """Up to ``n`` lines from the start of a file. The file system streams them to the driver: no job, no listing, no more than a buffer is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = (reader.readLine() for _ in range(n))
        return [line for line in lines if line is not None]
    finally:
        stream.close()


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in a file's first line, as Spark's CSV reader names columns: nameless and repeated ones get their position."""
    found = next(csv.reader(line.lstrip("\ufeff") for line in first_lines(spark, path, 1)), [])
    lowered = [c.lower() for c in found]
    return tuple(f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(found))


def known_headers(spark: SparkSession, manifest: str | None) -> dict[tuple[str, int], tuple[str, ...]]:
    """Headers that a stored manifest has, by first file and its size."""
    if manifest is None:
        return {}
    place = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return {}
    return {(r["first_file"], r["bytes"]): tuple(r["header"]) for r in spark.read.parquet(manifest).collect()}


def list_sources(spark: SparkSession, folder: str, manifest: str | None = None) -> list[Source]:
    """Sources by name with the header of their first file.

    One job lists the files, whatever their number; ``scan`` later checks each header against every file. With a
    ``manifest``, a path, headers are kept there and only sources whose first file is new are opened.
    """
    place = F.min(F.struct("path", "bytes"))
    firsts = list_files(spark, folder).groupBy("source").agg(place.alias("first")).orderBy("source").collect()
    root, known = root_of(spark, folder), known_headers(spark, manifest)

    def open_source(row) -> Source:
        path, size = row["first"]
        header = known.get((path, size)) or read_header(spark, path)
        return Source(row["source"], f"{root}/{row['source']}.csv", path, header, root)

    with ThreadPoolExecutor(HEADER_READERS) as pool:
        sources = list(pool.map(open_source, firsts))
    fresh = [(*row["first"], list(s.header)) for row, s in zip(firsts, sources) if tuple(row["first"]) not in known]
    if manifest is not None and fresh:
        table = spark.createDataFrame(fresh, "first_file string, bytes long, header array<string>")
        table.coalesce(1).write.mode("append").parquet(manifest)
    return sources


def headers_of(sources: Sequence[Source]) -> dict[str, list[str]]:
    return {s.name: s.columns for s in sources}


def header_manifest(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """One row per source and column with its position."""
    rows = [(s.name, i, c) for s in sources for i, c in enumerate(s.columns)]
    return spark.createDataFrame(rows, "source string, pos int, column string")


def inventory(spark: SparkSession, folder: str, sources: Sequence[Source]) -> DataFrame:
    """Files, bytes, megabytes and columns per source, by name."""
    widths = spark.createDataFrame([(s.name, len(s.header)) for s in sources], "source string, columns int")
    sizes = list_files(spark, folder).groupBy("source").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return (
        sizes.join(widths, "source")
        .withColumn("megabytes", F.col("bytes") / F.lit(1024.0 * 1024.0))
        .orderBy("source")
    )


def base_header(manifest: DataFrame) -> DataFrame:
    """The columns (pos, column) of the base source: among those of the most common width, the first by name."""
    widths = manifest.groupBy("source").agg(F.count("*").alias("width"))
    sharing = widths.withColumn("sharing", F.count("*").over(Window.partitionBy("width")))
    base = sharing.orderBy(F.desc("sharing"), "source").limit(1).select("source")
    return manifest.join(base, "source", "left_semi").select("pos", "column")


def header_drift(manifest: DataFrame) -> DataFrame:
    """One row (source, pos, column, difference) per column that a source has beyond the base header (``extra``) or lacks (``missing``)."""
    base = base_header(manifest)
    extra = manifest.join(base.select("column"), "column", "left_anti").withColumn("difference", F.lit("extra"))
    wanted = manifest.select("source").distinct().crossJoin(base)  # sources x one header
    missing = wanted.join(manifest.select("source", "column"), ["source", "column"], "left_anti").withColumn("difference", F.lit("missing"))
    order = ["source", "pos", "column", "difference"]
    return extra.select(order).unionAll(missing.select(order))


def merged_columns(spark: SparkSession, sources: Sequence[Source], action: str = "drop") -> list[str]:
    """Columns of the merged table: ``drop`` keeps those of the base header, ``keep`` adds what other sources have beyond it, in their order."""
    if action not in ("drop", "keep"):
        raise ValueError(f"unknown drift action {action!r}; expected 'drop' or 'keep'")
    if not sources:
        raise ValueError("no sources")
    manifest = header_manifest(spark, sources)
    columns = base_header(manifest).select(F.lit(None).cast("string").alias("source"), "pos", "column")
    if action == "keep":
        columns = columns.unionAll(header_drift(manifest).filter("difference = 'extra'").select("source", "pos", "column"))
    first = columns.groupBy("column").agg(F.min(F.struct(F.coalesce("source", F.lit("")), "pos")).alias("place"))
    return [r["column"] for r in first.orderBy("place").collect()]


def provenance(root: str) -> list[Column]:
    """Source day and the three columns that order rows as they lie in the landing folder.

    Ids grow along a scan and one block is read by one task, so (file, block, id) is the file order. The file is
    named by its path below the folder, so no two files share a name.
    """
    path = below(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), root)
    return [
        F.regexp_extract(path, ENTRY_PATTERN, 1).alias(SOURCE_DAY),
        path.alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("row_no"),
    ]


def scan(spark: SparkSession, header: Sequence[str], paths: Sequence[str], root: str | None = None) -> DataFrame:
    """All-text scan of files that share ``header``, names stripped and missing-value tokens NULL.

    ``enforceSchema=False`` makes Spark compare each file's header with the expected names: a file that
    drifts inside its source fails the read instead of shifting values into wrong columns.
    """
    schema = StructType([StructField(name, StringType()) for name in header])
    rows = spark.read.schema(schema).options(**CSV_OPTIONS, enforceSchema=False).csv(list(paths))
    texts = [missing_to_null(quoted(name)).alias(name.strip()) for name in header]
    return rows.select(*(provenance(root) if root is not None else []), *texts)


def preview_table(spark: SparkSession, sources: Sequence[Source], columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each source's first file as (source, pos, the given columns); columns that a source lacks are NULL.

    Lines come from the file system and are parsed by Spark's CSV parser, once per distinct header.
    """
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        lines = dict(zip((s.name for s in sources), pool.map(lambda s: first_lines(spark, s.first_file, n + 1)[1:], sources)))
    parsed = None
    for header in dict.fromkeys(s.header for s in sources):
        rows = [(s.name, i, line) for s in sources if s.header == header for i, line in enumerate(lines[s.name])]
        schema = ", ".join(f"{quoted_name(c.strip())} string" for c in header)
        told = spark.createDataFrame(rows, "source string, pos int, line string")
        cells = told.select("source", "pos", F.from_csv("line", schema, {"escape": '"', "quote": '"'}).alias("_cells"))
        names = {c.strip() for c in header}
        part = cells.select("source", "pos", *[(missing_to_null(F.col("_cells")[c]) if c in names else F.lit(None).cast("string")).alias(c) for c in columns])
        parsed = part if parsed is None else parsed.unionByName(part)
    return parsed


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def by_header(sources: Sequence[Source]) -> dict[tuple[str, ...], list[str]]:
    groups: dict[tuple[str, ...], list[str]] = {}
    for s in sources:
        groups.setdefault(s.header, []).append(s.path)
    return groups


def stack(spark: SparkSession, sources: Sequence[Source], columns: Sequence[str]) -> DataFrame:
    """All sources by column name, one scan per distinct header; absent columns are NULL."""
    stacked: DataFrame | None = None
    for header, paths in by_header(sources).items():
        rows = scan(spark, header, paths, sources[0].root)
        part = rows.select(*PROVENANCE, *[quoted(c) for c in columns if c in rows.columns])
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.select(*PROVENANCE, *[quoted(c) for c in columns])


def merge_sources(spark: SparkSession, sources: Sequence[Source], action: str = "drop") -> DataFrame:
    """One all-text table over all sources, drift resolved."""
    return stack(spark, sources, merged_columns(spark, sources, action))


def csv_row_counts(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Rows per source as they lie in the files, counted file by file without merging headers."""
    counted = None
    for header, paths in by_header(sources).items():
        rows = scan(spark, header, paths, sources[0].root).groupBy(F.col(SOURCE_DAY).alias("source")).agg(F.count("*").alias("csv_rows"))
        counted = rows if counted is None else counted.unionByName(rows)
    names = spark.createDataFrame([(s.name,) for s in sources], "source string")
    return names.join(counted, "source", "left").select("source", F.coalesce("csv_rows", F.lit(0)).alias("csv_rows"))


def merge_reconciliation(spark: SparkSession, sources: Sequence[Source], merged: DataFrame) -> DataFrame:
    """Per source: rows in its files, rows in the merged table, and whether they agree. Sources on one side only fail."""
    found = merged.groupBy(F.col(SOURCE_DAY).cast("string").alias("source")).agg(F.count("*").alias("merged_rows"))
    both = csv_row_counts(spark, sources).join(found, "source", "full")
    none = F.lit(0).cast("long")
    columns = [F.coalesce(c, none).alias(c) for c in ("csv_rows", "merged_rows")]
    return both.select("source", *columns).withColumn("passed", F.col("csv_rows") == F.col("merged_rows"))


def day_slices(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """All sources with every column any of them has; write partitioned by ``source_day``."""
    return stack(spark, sources, list(dict.fromkeys(c for s in sources for c in s.columns)))


def folder_bytes(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(folder)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def size_comparison(spark: SparkSession, csv_folder: str, parquet_folder: str) -> DataFrame:
    """Bytes of the CSV sources and of the merged Parquet table, and their ratio."""
    before = folder_bytes(spark, csv_folder, "*.csv").select(
        F.col("files").alias("csv_files"), F.col("bytes").alias("csv_bytes")
    )
    after = folder_bytes(spark, parquet_folder, "*.parquet")
    return before.withColumn("parquet_bytes", after.select("bytes").scalar()).withColumn(
        "ratio", F.col("csv_bytes") / F.nullif(F.col("parquet_bytes").cast("double"), F.lit(0.0))
    )
