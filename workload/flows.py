"""Flow records derived from the ``events`` table, in Spark and in SQL, by the same integer rules.

Every event is a flow. Dirty values are planted by remainders of the event id, and every twentieth event
comes a second time: a day later for every fortieth, an hour later otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Raw column -> SQL over event_id e, user_id u, value v, event_type k. Reads the same in both engines.
FEATURE_SQL = {
    "Dst Port": "CAST(e % 1024 AS STRING)",
    "Protocol": "CASE WHEN e % 97 = 0 THEN ' Protocol ' WHEN e % 101 = 0 THEN '1' WHEN e % 3 = 0 THEN '0' "
    "WHEN e % 3 = 1 THEN '6' ELSE '17' END",
    "Flow Duration": "CASE WHEN e % 53 = 0 THEN '-1' WHEN e % 61 = 0 THEN 'Infinity' WHEN e % 71 = 0 THEN 'abc' "
    "ELSE CAST(v AS STRING) END",
    "Tot Fwd Pkts": "CAST(u % 50 + 1 AS STRING)",
    "Tot Bwd Pkts": "CAST(e % 17 AS STRING)",
    "TotLen Fwd Pkts": "CAST((u * 7) % 1500 AS STRING)",
    "Fwd Pkt Len Mean": "CAST(v AS STRING)",
    "Flow Byts/s": "CASE WHEN e % 67 = 0 THEN 'NaN' WHEN e % 73 = 0 THEN '1e400' WHEN e % 79 = 0 THEN '1d' "
    "ELSE CONCAT(' ', CAST(e % 4096 AS STRING), 'e1') END",
    "Pkt Len Mean": "CAST(u % 100 AS STRING)",
    "Down/Up Ratio": "CAST(e % 5 AS STRING)",
    "Flow IAT Min": "CASE WHEN e % 11 = 0 THEN CONCAT('-', CAST(u AS STRING)) ELSE CAST(u AS STRING) END",
    "Fwd IAT Min": "CASE WHEN e % 29 = 0 THEN '-3.5' ELSE CAST(e % 1000 AS STRING) END",
    "Init Fwd Win Byts": "CASE WHEN e % 4 = 0 THEN '-1' ELSE CAST(u AS STRING) END",
    "Subflow Fwd Pkts": "CAST(u % 50 + 1 AS STRING)",
    "Subflow Bwd Pkts": "CASE WHEN e % 7 = 0 THEN '0' ELSE CAST(e % 17 AS STRING) END",
    "Fwd Seg Size Avg": "CAST(v AS STRING)",
    "Bwd PSH Flags": "CASE WHEN e % 1000 = 0 THEN '1' ELSE '0' END",
    "Fwd URG Flags": "CAST(e % 4 AS STRING)",
    "Label": "CASE WHEN e % 89 = 0 THEN '' WHEN e % 83 = 0 THEN 'nan' WHEN k = 'view' THEN 'Benign' "
    "WHEN e % 13 = 0 THEN CONCAT(k, ' ') ELSE k END",
}
IDENTIFIER_SQL = {
    "Flow ID": "CONCAT('f', CAST(e AS STRING))",
    "Src IP": "CONCAT('10.0.0.', CAST(e % 256 AS STRING))",
    "Src Port": "CAST(e % 65536 AS STRING)",
    "Dst IP": "CONCAT('10.0.1.', CAST(u % 256 AS STRING))",
}
RAW_COLUMNS = ["Dst Port", "Protocol", "Timestamp", *[c for c in FEATURE_SQL if c not in ("Dst Port", "Protocol")]]
ORDER = ["row_no"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flows_raw(spark: SparkSession, sf_dir: str, identifiers: bool = False, week: int | None = None) -> DataFrame:
    """All-text flow records with ``source_day`` and ``row_no``. Those of a ``week`` of the month, from 0, are in the order of ``row_no``.

    Rows are chosen and sorted as five plain columns, before their texts are made.
    """
    events = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("u"),
        F.col("value").alias("v"),
        F.col("event_type").alias("k"),
        "ts",
    )
    # A copy is the same row again with its own time and place: one scan, no union.
    copies = F.when(F.col("e") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shift = F.when(F.col("copy") == 0, F.lit(0)).when(F.col("e") % 40 == 0, F.lit(24)).otherwise(F.lit(1))
    rows = events.withColumn("copy", F.explode(copies)).withColumn(
        "ts", F.col("ts") + F.make_dt_interval(F.lit(0), shift)
    )
    if week is not None:
        rows = rows.filter(F.floor((F.dayofmonth("ts") - 1) / 7) == week).orderBy(F.col("e") * 2 + F.col("copy"))
    text = {**FEATURE_SQL, **(IDENTIFIER_SQL if identifiers else {})}
    columns: dict[str, Column] = {name: F.expr(sql) for name, sql in text.items()}
    columns["Timestamp"] = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    names = [*(IDENTIFIER_SQL if identifiers else []), *RAW_COLUMNS]
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd").alias("source_day"),
        (F.col("e") * 2 + F.col("copy")).alias("row_no"),
        *[columns[name].alias(name) for name in names],
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: a score in [0, 1] from the value and the target from the type."""
    cents = F.least(F.round(F.col("value") * 100).cast("long"), F.lit(50000))
    return read(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_type") != "view").cast("int").alias("Target"),
        (cents / F.lit(50000.0)).alias("score"),
    )


LINE_FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_cents"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a target that the features partly explain."""
    rule = ((F.col("l_quantity") > 30) & (F.col("l_discount") >= 0.05)) | (
        (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06)
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return read(spark, sf_dir, "lineitem").withColumns({"l_cents": cents, "Target": rule.cast("byte")})


# --- the same in SQL for the oracle -----------------------------------------------------------------
NUMBER_SQL = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def q(name: str) -> str:
    return f'"{name}"'


def clean_name(name: str) -> str:
    return name.replace(" ", "_").replace("/", "_")


def number(name: str) -> str:
    return f"CASE WHEN regexp_matches({q(name)}, {NUMBER_SQL}) THEN TRY_CAST(trim({q(name)}) AS DOUBLE) END"


def finite_number(name: str) -> str:
    n = number(name)
    return f"CASE WHEN abs({n}) < CAST('Infinity' AS DOUBLE) THEN {n} END"


def flows_cte(identifiers: bool = False) -> str:
    text = {**FEATURE_SQL, **(IDENTIFIER_SQL if identifiers else {})}
    cells = ",\n  ".join(f"{sql} AS {q(name)}" for name, sql in text.items())
    return f"""src AS (
  SELECT event_id AS e, user_id AS u, value AS v, event_type AS k, ts, 0 AS copy FROM events
  UNION ALL
  SELECT event_id, user_id, value, event_type,
    CASE WHEN event_id % 40 = 0 THEN ts + INTERVAL 1 DAY ELSE ts + INTERVAL 1 HOUR END, 1
  FROM events WHERE event_id % 20 = 0
),
flows AS (
  SELECT strftime(ts, '%Y-%m-%d') AS source_day, e * 2 + copy AS row_no,
  strftime(ts, '%d/%m/%Y %H:%M:%S') AS "Timestamp",
  {cells}
  FROM src
)"""


LINES_CTE = """lines AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents,
  CAST(CASE WHEN (l_quantity > 30 AND l_discount >= CAST(0.05 AS DOUBLE))
    OR (l_returnflag = 'R' AND l_tax > CAST(0.06 AS DOUBLE)) THEN 1 ELSE 0 END AS TINYINT) AS "Target"
  FROM lineitem
)"""

SCORED_CTE = """scored AS (
  SELECT event_id, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS "Target",
  least(CAST(round(value * 100) AS BIGINT), 50000) / CAST(50000 AS DOUBLE) AS score
  FROM events
)"""
