"""Typed tables, small parameters and models on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.operators.profile import quoted

DEFAULT_THRESHOLD = 0.5


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Snappy Parquet, optionally one folder per value such as the source day."""
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*[quoted(c) for c in columns]) if columns is not None else df


def schema_table(df: DataFrame) -> DataFrame:
    """Position, name and type of every column; no data is read."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, type string")


def row_count(df: DataFrame) -> DataFrame:
    """Rows of a table; Parquet answers without reading a column."""
    return df.agg(F.count("*").alias("rows"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV that keeps blanks at the ends of texts."""
    df.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"').csv(path)


def save_threshold(spark: SparkSession, path: str, threshold: float) -> None:
    """Store the operating threshold with six decimals."""
    spark.createDataFrame([(round(float(threshold), 6),)], "threshold double").write.mode("overwrite").parquet(path)


def load_threshold(spark: SparkSession, path: str, default: float = DEFAULT_THRESHOLD) -> float:
    """The stored threshold, or the default where none was stored."""
    try:
        row = spark.read.schema("threshold double").parquet(path).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return default if row is None or row["threshold"] is None else float(row["threshold"])


def save_model(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def ensemble_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The table of nodes of a saved ensemble of trees: ``treeID`` and ``nodeData``, a row per node."""
    return spark.read.parquet(f"{path}/data")
