"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and a UTC clock. Extra settings win over the defaults.

    Flow tables are 60 to 80 columns wide. Methods generated for that many expressions pass the JVM's limit
    for compilation (8,000 bytes) and would run interpreted, so Spark is told to split them instead.
    """
    settings = {
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    path is invisible to the other executors, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flowsift-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


_OPEN: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was put below the shared folder inside. Nothing lazy that reads it may leave the block."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    own = f"{shared_root(spark)}/flowsift/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(own)
    return f"{own}/{name}"


def materialise(df: DataFrame, name: str = "table", block_mb: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    ``block_mb`` sizes the row groups, which tasks share out, of tables with few and large rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**({"parquet.block.size": block_mb << 20} if block_mb else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
