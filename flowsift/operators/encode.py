"""Turn cleaned records into numeric ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.functions.scalars import epoch_seconds
from flowsift.schema import BENIGN, LABEL, PROTOCOL, PROTOCOLS, TARGET, TIME_BASED, TIMESTAMP, check_strategy


def one_hot_name(code: int) -> str:
    return f"{PROTOCOL}_{code}"


ONE_HOTS = [one_hot_name(code) for code in PROTOCOLS]


def encode_protocol(df: DataFrame) -> DataFrame:
    """Three 0/1 bytes for the fixed vocabulary; any other protocol leaves all three at 0."""
    code = F.col(PROTOCOL).try_cast("int")
    hots = {one_hot_name(p): F.coalesce(code == p, F.lit(False)).cast("byte") for p in PROTOCOLS}
    return df.withColumns(hots).drop(PROTOCOL)


def is_attack(label: Column) -> Column:
    return (label != F.lit(BENIGN)).cast("byte")


def encode_target(df: DataFrame) -> DataFrame:
    return df.withColumn(TARGET, is_attack(F.col(LABEL))).drop(LABEL)


def encode_timestamp(df: DataFrame) -> DataFrame:
    """Timestamp text to epoch seconds; it orders days later and is never a feature."""
    return df.withColumn(TIMESTAMP, epoch_seconds(F.col(TIMESTAMP)))


def encode(df: DataFrame, strategy: str) -> DataFrame:
    """The whole encoding. Check ``gates.encode_input_gate`` first: unreadable timestamps become NULL here."""
    check_strategy(strategy)
    encoded = encode_target(encode_protocol(df))
    return encode_timestamp(encoded) if strategy == TIME_BASED else encoded


def one_hot_totals(df: DataFrame) -> DataFrame:
    """Rows set per one-hot column."""
    sums = df.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ONE_HOTS])
    return sums.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows_set")) for c in ONE_HOTS]))
    )


def protocol_values(df: DataFrame) -> DataFrame:
    """Distinct protocol codes with their row counts, and whether the vocabulary knows them."""
    code = F.col(PROTOCOL).try_cast("int").alias("protocol")
    return (
        df.filter(F.col(PROTOCOL).isNotNull())
        .groupBy(code)
        .agg(F.count("*").alias("n"))
        .withColumn("known", F.coalesce(F.col("protocol").isin(PROTOCOLS), F.lit(False)))
    )


def class_balance(df: DataFrame, target: str = TARGET, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per class and the attack share in percent, optionally per group such as split side."""
    attack = F.count_if(F.col(target) == 1)
    n = F.count("*")
    return df.groupBy(*by).agg(
        F.count_if(F.col(target) == 0).alias("benign_rows"),
        attack.alias("attack_rows"),
        F.when(n > 0, attack * 100.0 / n).alias("attack_pct"),
    )
