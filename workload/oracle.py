"""SQL for the registered queries, written against the given tables only."""

from __future__ import annotations

from flowsift.schema import MISSING_TOKENS, NEAR_CONSTANT, REDUNDANT_PAIRS, SAMPLED_FEATURES
from workload.flows import (
    IDENTIFIER_SQL,
    LINE_FEATURES,
    LINE_KEY,
    LINES_CTE,
    RAW_COLUMNS,
    SCORED_CTE,
    clean_name,
    finite_number,
    flows_cte,
    q,
)
from workload.queries import CLEAN_STATS, DRIFTED_WEEK, LINE_COLUMNS, LOGGED, RAW_WIDTH, WEEKS

SHARE = "CAST(0.2 AS DOUBLE)"
DROPPED = set(NEAR_CONSTANT) | {a for a, _ in REDUNDANT_PAIRS} | {"Dst Port"} | set(IDENTIFIER_SQL)
FEATURES = [c for c in RAW_COLUMNS if c not in DROPPED and c not in ("Label", "Timestamp")]
CLEAN = [clean_name(c) for c in FEATURES]
NUMERIC = [c for c in CLEAN if c != "Protocol"]
STRAY = """trim("Protocol") = 'Protocol'"""
EMPTY = """("Label" IS NULL OR trim("Label") IN ('nan', 'NaN', 'null', 'Null', ''))"""


def r(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def names(columns) -> str:
    return ", ".join(q(c) for c in columns)


FLOWS = flows_cte()

TYPED = f"""typed AS (
  SELECT source_day, row_no, "Timestamp", {STRAY} AS stray, {EMPTY} AS empty, trim("Label") AS "Label",
  {", ".join(f"{finite_number(c)} AS {q(clean_name(c))}" for c in FEATURES)}
  FROM flows
)"""
ALL_THERE = " AND ".join(f"{q(c)} IS NOT NULL" for c in CLEAN)


def clean_cte(by_day: bool = False) -> str:
    day = "source_day, " if by_day else ""
    time = '"Timestamp", source_day, ' if by_day else ""
    clipped = ", ".join(
        f"CASE WHEN {q(c)} < 0 THEN 0.0 ELSE {q(c)} END AS {q(c)}" if "IAT" in c else q(c) for c in CLEAN
    )
    return f"""{FLOWS},
{TYPED},
usable AS (
  SELECT * FROM typed WHERE NOT stray AND NOT empty AND {ALL_THERE} AND "Flow_Duration" >= 0
),
cleaned AS (
  SELECT {time}row_no, "Label", {clipped} FROM usable
  QUALIFY row_number() OVER (PARTITION BY {day}"Label", {names(CLEAN)} ORDER BY row_no) = 1
)"""


def encoded_cte(by_day: bool = False) -> str:
    hots = ", ".join(
        f'CAST(CASE WHEN trunc("Protocol") = {p} THEN 1 ELSE 0 END AS TINYINT) AS "Protocol_{p}"' for p in (0, 6, 17)
    )
    time = (
        """CAST(epoch(strptime("Timestamp", '%d/%m/%Y %H:%M:%S')) AS BIGINT) AS "Timestamp", source_day, """
        if by_day
        else ""
    )
    return f"""{clean_cte(by_day)},
encoded AS (
  SELECT {time}row_no, {names(NUMERIC)}, {hots},
  CAST(CASE WHEN "Label" <> 'Benign' THEN 1 ELSE 0 END AS TINYINT) AS "Target" FROM cleaned
)"""


def sides_cte(table: str, key: list[str], name: str = "sided", held: str = "test", keep: str = "train", side: str = "side") -> str:
    text = " || '|' || ".join(f"CAST({q(k)} AS VARCHAR)" for k in key)
    return f"""{name}_class AS (SELECT "Target", count(*) AS n FROM {table} GROUP BY 1),
{name}_total AS (
  SELECT CAST(sum(n) AS HUGEINT) AS total, CAST(ceil({SHARE} * sum(n)) AS HUGEINT) AS held FROM {name}_class
),
{name}_part AS (
  SELECT "Target", n, (n * (total - held)) // total AS whole, (n * (total - held)) % total AS rest, total - held AS keep
  FROM {name}_class, {name}_total
),
{name}_quota AS (
  SELECT "Target", n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, "Target")
    <= keep - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_part
),
{name} AS (
  SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY t."Target" ORDER BY md5({text} || '|42'), {names(key)}) <= quota
    THEN '{held}' ELSE '{keep}' END AS {side}
  FROM {table} t JOIN {name}_quota USING ("Target")
)"""


DAY_TABLE = """days AS (
  SELECT source_day, min("Timestamp") AS first_ts, max("Timestamp") AS last_ts, count(*) AS "rows",
  count(*) FILTER ("Target" = 1) AS attack_rows, 100.0 * count(*) FILTER ("Target" = 1) / count(*) AS attack_pct
  FROM encoded GROUP BY 1
)"""
DAY_SIDES = f"""day_sides AS (
  SELECT *, CASE WHEN coalesce(sum("rows") OVER (ORDER BY first_ts DESC, source_day DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {SHARE} * sum("rows") OVER () THEN 'test' ELSE 'train' END AS side
  FROM days
)"""
CURVE = f"""{SCORED_CTE},
counts AS (
  SELECT score, count(*) FILTER ("Target" = 1) AS pos, count(*) FILTER ("Target" <> 1) AS neg FROM scored GROUP BY 1
),
curve AS (
  SELECT score AS threshold, pos, neg,
  CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS total_pos, CAST(sum(neg) OVER () AS BIGINT) AS total_neg,
  lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM counts WINDOW w AS (ORDER BY score DESC)
),
rated AS (
  SELECT *, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(total_pos AS DOUBLE) AS recall FROM curve
),
best AS (
  SELECT threshold, "precision", recall,
  (2 * "precision" * recall) / ("precision" + recall + CAST(1e-9 AS DOUBLE)) AS f1
  FROM rated ORDER BY f1 DESC, threshold LIMIT 1
)"""


def confusion_cte(threshold: str) -> str:
    return f"""{SCORED_CTE},
cells AS (
  SELECT count(*) FILTER (score >= {threshold} AND "Target" = 1) AS tp,
  count(*) FILTER (score >= {threshold} AND "Target" = 0) AS fp,
  count(*) FILTER (score < {threshold} AND "Target" = 1) AS fn,
  count(*) FILTER (score < {threshold} AND "Target" = 0) AS tn FROM scored
)"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def f_one(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, c = f"({ratio(tp, f'({tp} + {fp})')})", f"({ratio(tp, f'({tp} + {fn})')})"
    return p, c, f"({ratio(f'(2.0 * {p} * {c})', f'({p} + {c})')})"


def sweep(threshold: str, extra: str) -> str:
    p, c, f = f_one("tp", "fp", "fn")
    return f"""WITH {extra},
op AS ({threshold}),
grid AS (
  SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(1, 100) g(i) UNION SELECT round(thr, 6) FROM op
),
swept AS (
  SELECT t, count(*) FILTER (score >= t AND "Target" = 1) AS tp, count(*) FILTER (score >= t AND "Target" = 0) AS fp,
  count(*) FILTER (score < t AND "Target" = 1) AS fn, count(*) FILTER (score < t AND "Target" = 0) AS tn
  FROM grid, scored GROUP BY t
)
SELECT round(t, 6) AS threshold, tp, fp, fn, tn, {r(p)} AS "precision", {r(c)} AS recall, {r(f)} AS f1,
abs(t - thr) <= CAST(1e-8 AS DOUBLE) + CAST(1e-5 AS DOUBLE) * abs(thr) AS is_operating_point FROM swept, op"""


FIXED_THRESHOLD = "SELECT CAST(0.1234567 AS DOUBLE) AS thr"


def funnel(by_day: bool = False) -> str:
    day = "source_day" if by_day else "'all'"
    out = "source_day, " if by_day else ""
    return f"""WITH {FLOWS},
{TYPED},
tagged AS (
  SELECT *, {day} AS grp, CASE WHEN stray OR empty THEN 1 WHEN NOT ({ALL_THERE}) THEN 2
    WHEN "Flow_Duration" < 0 THEN 3 ELSE 4 END AS rule FROM typed
),
per AS (
  SELECT grp, count(*) AS total, count(*) FILTER (rule = 1) AS d1, count(*) FILTER (rule = 2) AS d2,
  count(*) FILTER (rule = 3) AS d3 FROM tagged GROUP BY 1
),
uniq AS (
  SELECT grp, count(*) AS u FROM (SELECT DISTINCT grp, "Label", {names(CLEAN)} FROM tagged WHERE rule = 4) GROUP BY 1
),
j AS (SELECT per.grp AS source_day, total, d1, d2, d3, total - d1 - d2 - d3 - coalesce(u, 0) AS d4 FROM per LEFT JOIN uniq USING (grp))
SELECT {out}CAST(1 AS INTEGER) AS step_no, 'ghost_rows' AS step, total AS rows_in, d1 AS rows_dropped, total - d1 AS rows_out FROM j
UNION ALL SELECT {out}2, 'unusable_numbers', total - d1, d2, total - d1 - d2 FROM j
UNION ALL SELECT {out}3, 'negative_duration', total - d1 - d2, d3, total - d1 - d2 - d3 FROM j
UNION ALL SELECT {out}4, 'duplicates', total - d1 - d2 - d3, d4, total - d1 - d2 - d3 - d4 FROM j"""


def label_mix(table: str, prefix: str) -> str:
    return f"""WITH {prefix}
SELECT "Label", count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct,
"Label" <> trim("Label") AS padded FROM {table} WHERE "Label" IS NOT NULL GROUP BY "Label" """


def union(selects) -> str:
    return "\nUNION ALL ".join(selects)


def stats(table: str, columns: dict[str, str]) -> str:
    return union(
        f"SELECT '{name}' AS \"column\", count(v) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, "
        f"{r('min(v)')} AS \"min\", {r('max(v)')} AS \"max\" FROM (SELECT {value} AS v FROM {table})"
        for name, value in columns.items()
    )


def constants(table: str, columns: dict[str, str]) -> str:
    return union(
        f"SELECT '{name}' AS \"column\", count(DISTINCT v) AS distinct_values, "
        f"{r('100.0 * count(*) FILTER (v = 0) / count(*)')} AS zero_pct, {r('stddev_samp(v)')} AS std, "
        f"count(DISTINCT v) <= 3 AND 100.0 * count(*) FILTER (v = 0) / count(*) > 99.0 AS droppable "
        f"FROM (SELECT {value} AS v FROM {table})"
        for name, value in columns.items()
    )


def gate(name: str, observed: str, expected: str, passed: str, severity: str = "error") -> str:
    return (
        f"SELECT '{name}' AS \"check\", CAST({observed} AS DOUBLE) AS observed, '{expected}' AS expected, "
        f"'{severity}' AS severity, {passed} AS passed"
    )


def clean_gate(by_day: bool, width: int, labels: int) -> str:
    lowest = "least(" + ", ".join(f"min({q(c)})" for c in CLEAN if "IAT" in c) + ")"
    present = int(by_day)
    columns = CLEAN + ["Label"] + (["Timestamp"] if by_day else [])
    return f"WITH {clean_cte(by_day)}\n" + union(
        [
            gate("width", str(len(columns)), str(width), str(len(columns) == width).lower()),
            gate("dropped_columns", "0", "0 survivors", "true"),
            gate("timestamp_presence", str(present), str(present), "true"),
            gate("column_names", "0", "0 malformed", "true"),
            gate("missing_cells", "count(*) FILTER (NOT (" + ALL_THERE + '))', "0", "count(*) FILTER (NOT (" + ALL_THERE + ")) = 0") + " FROM cleaned",
            gate("infinite_cells", "0", "0", "true"),
            gate("min_duration", 'min("Flow_Duration")', ">= 0", 'min("Flow_Duration") >= 0') + " FROM cleaned",
            gate("min_interval", lowest, ">= 0", f"{lowest} >= 0") + " FROM cleaned",
            gate("label_count", 'count(DISTINCT "Label")', str(labels), f'count(DISTINCT "Label") = {labels}') + " FROM cleaned",
            gate("padded_labels", "count(DISTINCT \"Label\") FILTER (\"Label\" <> trim(\"Label\"))", "0", "count(*) FILTER (\"Label\" <> trim(\"Label\")) = 0") + " FROM cleaned",
        ]
    )


def matrix(key: str, table: str) -> str:
    floats = ", ".join(f"CAST({q(c)} AS FLOAT) AS {q(c)}" for c in NUMERIC)
    return f'SELECT {key}, {floats}, "Protocol_0", "Protocol_6", "Protocol_17", "Target", side FROM {table}'


def description() -> str:
    parts = []
    for c in RAW_COLUMNS:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS \"count\", count(*) AS \"unique\", "
            f"first(v ORDER BY n DESC, v) AS top, max(n) AS freq "
            f"FROM (SELECT {q(c)} AS v, count(*) AS n FROM flows WHERE {q(c)} IS NOT NULL GROUP BY 1)"
        )
    return f"WITH {FLOWS}\n" + union(parts)


def smallest_values() -> str:
    return f"WITH {FLOWS}\n" + union(
        f"SELECT '{c}' AS \"column\", 'string' AS \"type\", CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank, v AS \"value\" "
        f"FROM (SELECT DISTINCT {q(c)} AS v FROM flows WHERE {q(c)} IS NOT NULL ORDER BY v LIMIT 3)"
        for c in RAW_COLUMNS
    )


def correlations() -> str:
    parts = []
    for a in LINE_COLUMNS:
        for b in LINE_COLUMNS:
            value = "1.0" if a == b else f"corr({q(a)}, {q(b)})"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(value)} AS corr FROM lines" + (" LIMIT 1" if a == b else ""))
    return f"WITH {LINES_CTE}\n" + union(f"({p})" for p in parts)


def landing(kept: bool) -> str:
    tokens = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
    week = "'week-' || CAST((CAST(substr(source_day, 9, 2) AS INTEGER) - 1) // 7 AS VARCHAR)"
    columns = [f"CASE WHEN {q(c)} IN ({tokens}) THEN NULL ELSE {q(c)} END AS {q(c)}" for c in RAW_COLUMNS]
    if kept:
        columns += [f"CASE WHEN {week} = '{DRIFTED_WEEK}' THEN {q(c)} END AS {q(c)}" for c in IDENTIFIER_SQL]
    return f"WITH {flows_cte(kept)}\nSELECT {week} AS source_day, {', '.join(columns)} FROM flows"


WEEK = "'week-' || CAST((CAST(substr(source_day, 9, 2) AS INTEGER) - 1) // 7 AS VARCHAR)"


def week_flows(cte: str) -> str:
    """Flows whose source day is the week file they were written to."""
    return cte.replace(
        "strftime(ts, '%Y-%m-%d') AS source_day",
        "'week-' || CAST((CAST(strftime(ts, '%d') AS INTEGER) - 1) // 7 AS VARCHAR) AS source_day",
    )


def histogram() -> str:
    edge = "CASE WHEN {i} = 50 THEN high ELSE low + {i} * ((high - low) / 50) END"
    return f"""WITH {SCORED_CTE},
spans AS (
  SELECT "Target", CASE WHEN min(score) = max(score) THEN min(score) - 0.5 ELSE min(score) END AS low,
  CASE WHEN min(score) = max(score) THEN max(score) + 0.5 ELSE max(score) END AS high FROM scored GROUP BY 1
),
bins AS (
  SELECT "Target", CAST(i AS INTEGER) AS bin, {edge.format(i="i")} AS bin_low, {edge.format(i="(i + 1)")} AS bin_high
  FROM spans, range(0, 50) g(i)
)
SELECT b."Target", bin, {r("min(bin_low)")} AS bin_low, {r("min(bin_high)")} AS bin_high, count(s.score) AS n
FROM bins b LEFT JOIN scored s ON s."Target" = b."Target" AND s.score >= bin_low
  AND (s.score < bin_high OR (bin = 49 AND s.score = bin_high))
GROUP BY 1, 2"""


def calibration() -> str:
    slot = " + ".join(f"CASE WHEN score > CAST('{i * 0.1!r}' AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 10))
    return f"""WITH {SCORED_CTE}
SELECT CAST({slot} AS INTEGER) AS bin, {r("avg(score)")} AS mean_score, {r('avg("Target")')} AS attack_rate, count(*) AS n
FROM scored GROUP BY 1"""


def class_report() -> str:
    a, b = f_one("tp", "fp", "fn"), f_one("tn", "fn", "fp")
    columns = ("precision", "recall", "f1")

    def row(name: str, measures, support: str) -> str:
        cells = ", ".join(f"{r(m, 4) if m else 'CAST(NULL AS DOUBLE)'} AS \"{c}\"" for m, c in zip(measures, columns))
        return f"SELECT '{name}' AS \"row\", {cells}, {support} AS support FROM cells"

    total = "(tp + fp + fn + tn)"
    weighted = [f"({y} * (tn + fp) + {x} * (tp + fn)) / {total}" for x, y in zip(a, b)]
    return f"WITH {confusion_cte('CAST(0.1 AS DOUBLE)')}\n" + union(
        [
            row("Benign (0)", b, "tn + fp"),
            row("Attack (1)", a, "tp + fn"),
            row("accuracy", (None, None, f"(tp + tn) / CAST({total} AS DOUBLE)"), total),
            row("macro avg", [f"({x} + {y}) / 2.0" for x, y in zip(a, b)], total),
            row("weighted avg", weighted, total),
        ]
    )


def quartiles(columns=LOGGED) -> str:
    return f"WITH {LINES_CTE}\n" + union(
        f"SELECT '{c}' AS feature, \"Target\", count(v) AS n, {r('min(v)')} AS low, {r('quantile_cont(v, 0.25)')} AS q1, "
        f"{r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.75)')} AS q3, {r('max(v)')} AS high "
        f"FROM (SELECT \"Target\", ln(1 + {q(c)}) AS v FROM lines) GROUP BY \"Target\""
        for c in columns
    )


def log_bins(columns=LOGGED) -> str:
    return f"WITH {LINES_CTE}\n" + union(
        f"SELECT '{c}' AS feature, \"Target\", CAST(floor(ln(1 + {q(c)})) AS INTEGER) AS bin, "
        f"count(*) AS n FROM lines GROUP BY 2, 3"
        for c in columns
    )


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["clean_label_mix"] = label_mix("cleaned", clean_cte())
    sql["clean_rows_stratified"] = f'WITH {clean_cte()} SELECT row_no, "Label", {names(CLEAN)} FROM cleaned'
    sql["clean_rows_by_day"] = (
        f'WITH {clean_cte(True)} SELECT row_no, source_day, "Timestamp", "Label", {names(CLEAN)} FROM cleaned'
    )
    sql["cleaning_funnel"] = funnel()
    sql["cleaning_funnel_by_day"] = funnel(True)
    sql["shrinkage"] = f"""WITH {clean_cte()},
n AS (SELECT (SELECT count(*) FROM flows) AS a, (SELECT count(*) FROM cleaned) AS b)
SELECT a AS raw_rows, b AS clean_rows, a - b AS purged_rows, {r('(a - b) * 100.0 / a')} AS purged_pct FROM n"""

    sql["raw_label_distribution"] = label_mix("flows", FLOWS)
    sql["ghost_rows"] = f"""WITH {FLOWS}
SELECT count(*) FILTER ({STRAY}) AS stray_headers,
count(*) FILTER ("Label" IS NULL OR "Label" IN ('nan', 'NaN', 'null', 'Null', '')) AS empty_labels FROM flows"""
    sql["raw_feature_stats"] = f"WITH {FLOWS}\n" + stats("flows", {c: finite_number(c) for c in SAMPLED_FEATURES})
    sql["clean_feature_stats"] = f"WITH {clean_cte()}\n" + stats("cleaned", {c: q(c) for c in CLEAN_STATS})
    sql["text_description"] = description()
    duration = finite_number("Flow Duration")
    sql["negative_duration"] = f"""WITH {FLOWS}
SELECT count(*) AS "rows", count(*) FILTER (v < 0) AS negative_rows, {r('100.0 * count(*) FILTER (v < 0) / count(*)')} AS negative_pct
FROM (SELECT {duration} AS v FROM flows)"""
    sql["negative_duration_labels"] = f"""WITH {FLOWS}
SELECT "Label", count(*) AS n FROM flows WHERE {duration} < 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""
    sql["negative_intervals"] = f"WITH {FLOWS}\n" + union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (v < 0) AS negative_rows, {r('min(v)')} AS min_value "
        f"FROM (SELECT {finite_number(c)} AS v FROM flows)"
        for c in RAW_COLUMNS
        if "IAT" in c
    )
    sql["near_constant_columns"] = f"WITH {FLOWS}\n" + constants(
        "flows", {c: finite_number(c) for c in NEAR_CONSTANT if c in RAW_COLUMNS}
    )
    sql["near_constant_line_columns"] = constants("lineitem", {c: f"CAST({q(c)} AS DOUBLE)" for c in LINE_FEATURES})
    sql["redundant_columns"] = f"WITH {FLOWS}\n" + union(
        f"SELECT '{a}' AS dropped, '{b}' AS kept, {r('corr(x, y)')} AS corr, coalesce(corr(x, y) > 0.9999, false) AS droppable "
        f"FROM (SELECT {finite_number(a)} AS x, {finite_number(b)} AS y FROM flows)"
        for a, b in REDUNDANT_PAIRS
        if a in RAW_COLUMNS and b in RAW_COLUMNS
    )
    sql["column_profile"] = smallest_values()
    sql["first_raw_rows"] = f"WITH {FLOWS} SELECT source_day, row_no, {names(RAW_COLUMNS)} FROM flows ORDER BY row_no LIMIT 5"
    sql["first_encoded_rows"] = f"WITH {encoded_cte()} SELECT * FROM encoded ORDER BY row_no LIMIT 5"
    sql["target_correlations"] = f"WITH {LINES_CTE}\nSELECT * FROM (" + union(
        f"SELECT '{c}' AS feature, {r(f'corr({q(c)}, {q('Target')})')} AS corr FROM lines" for c in LINE_FEATURES
    ) + ") ORDER BY abs(corr) DESC, feature LIMIT 15"
    sql["correlation_matrix"] = correlations()
    text = " || '|' || ".join(f"CAST({q(k)} AS VARCHAR)" for k in LINE_KEY)
    sql["sampled_rows"] = f"""WITH {LINES_CTE}
SELECT {names(LINE_KEY)}, "Target" FROM lines ORDER BY md5({text} || '|42'), {names(LINE_KEY)} LIMIT 2000"""
    sql["log_feature_quartiles"] = quartiles()
    sql["log_feature_histogram"] = log_bins()

    sql["merged_gate"] = f"WITH {FLOWS}\n" + union(
        [
            gate("row_count", "count(*)", "16233002 within 50000", "abs(count(*) - 16233002) < 50000") + " FROM flows",
            gate("known_width", str(RAW_WIDTH), f"{RAW_WIDTH} or {RAW_WIDTH + 4}", "true"),
            gate("base_width", str(RAW_WIDTH), str(RAW_WIDTH), "true", "warning"),
            gate("text_columns", "0", "0 other columns", "true"),
        ]
    )
    sql["cleaned_gate"] = clean_gate(False, 13, 5)
    sql["cleaned_by_day_gate"] = clean_gate(True, 14, 15)
    every = [c for c in RAW_COLUMNS if c not in ("Label", "Timestamp")]
    missing = " + ".join(f"CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END" for c in every)
    infinite = " + ".join(f"CASE WHEN abs({q(c)}) = CAST('Infinity' AS DOUBLE) THEN 1 ELSE 0 END" for c in every)
    parsed = ", ".join(
        f"CASE WHEN {q(c)} = '1e400' THEN CAST('Infinity' AS DOUBLE) ELSE {finite_number(c)} END AS {q(c)}" for c in every
    )
    sql["health_counts"] = f"""WITH {FLOWS}, parsed AS (SELECT {parsed} FROM flows)
SELECT CAST(sum({missing}) AS BIGINT) AS missing_cells, CAST(sum({infinite}) AS BIGINT) AS infinite_cells,
{r('min("Flow Duration")')} AS min_duration, {r('least(min("Flow IAT Min"), min("Fwd IAT Min"))')} AS min_interval FROM parsed"""
    unknown = 'count(*) FILTER (trunc("Protocol") NOT IN (0, 6, 17))'
    bad_time = """count(*) FILTER (try_strptime("Timestamp", '%d/%m/%Y %H:%M:%S') IS NULL)"""
    sql["encode_input_gate"] = f"WITH {clean_cte(True)}\n" + union(
        [
            gate("leaking_columns", "0", "0", "true"),
            gate("required_columns", "0", "0 absent", "true"),
            gate("timestamp_presence", "1", "1", "true"),
            gate("unknown_protocols", unknown, "0 rows", f"{unknown} = 0", "warning") + " FROM cleaned",
            gate("unreadable_timestamps", bad_time, "0", f"{bad_time} = 0") + " FROM cleaned",
        ]
    )
    holes = "count(*) FILTER (" + " OR ".join(f"{q(c)} IS NULL" for c in NUMERIC) + ")"
    sql["encoded_gate"] = f"WITH {encoded_cte()}\n" + union(
        [
            gate("numeric_columns", "0", "0 other columns", "true"),
            gate("rows_with_missing_cells", holes, "0", f"{holes} = 0") + " FROM encoded",
        ]
    )
    sided = f"WITH {encoded_cte()},\n{sides_cte('encoded', ['row_no'])}"
    share = {s: f"100.0 * count(*) FILTER (side = '{s}' AND \"Target\" = 1) / count(*) FILTER (side = '{s}')" for s in ("train", "test")}
    drift = f"abs({share['train']} - {share['test']})"
    sql["split_gate"] = sided + "\n" + union(
        [gate(f"{s}_rows", f"count(*) FILTER (side = '{s}')", "> 0", f"count(*) FILTER (side = '{s}') > 0") + " FROM sided" for s in share]
        + [
            gate(f"{s}_attacks", f"count(*) FILTER (side = '{s}' AND \"Target\" = 1)", "> 0", f"count(*) FILTER (side = '{s}' AND \"Target\" = 1) > 0", "warning") + " FROM sided"
            for s in share
        ]
        + [gate("attack_share_drift", r(drift), "< 0.01 points", f"{drift} < greatest(0.01, 100.0 / least(count(*) FILTER (side = 'train'), count(*) FILTER (side = 'test')))") + " FROM sided"]
    )

    sql["encoded_rows_stratified"] = f"WITH {encoded_cte()} SELECT * FROM encoded"
    sql["encoded_rows_by_day"] = f"WITH {encoded_cte(True)} SELECT * FROM encoded"
    sql["stacked_day_slices"] = sql["encoded_rows_by_day"]
    sql["one_hot_totals"] = f"WITH {encoded_cte()}\n" + union(
        f"SELECT 'Protocol_{p}' AS \"column\", CAST(sum(\"Protocol_{p}\") AS BIGINT) AS rows_set FROM encoded" for p in (0, 6, 17)
    )
    sql["protocol_values"] = f"""WITH {clean_cte()}
SELECT CAST(trunc("Protocol") AS INTEGER) AS protocol, count(*) AS n, trunc("Protocol") IN (0, 6, 17) AS known
FROM cleaned GROUP BY 1, 3"""
    balance = f"""count(*) FILTER ("Target" = 0) AS benign_rows, count(*) FILTER ("Target" = 1) AS attack_rows,
{r('100.0 * count(*) FILTER ("Target" = 1) / count(*)')} AS attack_pct"""
    sql["class_balance"] = f"WITH {encoded_cte()} SELECT {balance} FROM encoded"
    sql["raw_epoch_seconds"] = f"""WITH {FLOWS}
SELECT row_no, CAST(epoch(strptime("Timestamp", '%d/%m/%Y %H:%M:%S')) AS BIGINT) AS epoch_s FROM flows"""

    sql["stratified_sides"] = f'{sided} SELECT row_no, "Target", side FROM sided'
    sql["stratified_line_sides"] = (
        f"WITH {LINES_CTE},\n{sides_cte('lines', LINE_KEY)} SELECT {names(LINE_KEY)}, \"Target\", side FROM sided"
    )
    sql["stratified_matrix"] = f"{sided} {matrix('row_no', 'sided')}"
    sql["rejoined_matrix"] = f"""WITH {encoded_cte()}
SELECT row_no, CAST("Flow_Duration" AS FLOAT) AS "Flow_Duration", "Target" FROM encoded"""
    sql["side_class_balance"] = f"{sided} SELECT side, {balance} FROM sided GROUP BY side"
    pct = 'avg(CAST("Target" AS DOUBLE) * 100) FILTER (side = \'{}\')'
    sql["split_drift"] = f"""{sided}
SELECT {r('avg(CAST("Target" AS DOUBLE) * 100)')} AS all_pct, {r(pct.format('train'))} AS train_pct, {r(pct.format('test'))} AS test_pct,
{r(f"abs({pct.format('train')} - {pct.format('test')})")} AS drift FROM sided"""
    by_day = f"WITH {encoded_cte(True)},\n{DAY_TABLE}"
    sql["day_balance"] = f'{by_day} SELECT source_day, first_ts, last_ts, "rows", attack_rows, {r("attack_pct")} AS attack_pct FROM days'
    sql["day_sides_by_share"] = f'{by_day},\n{DAY_SIDES} SELECT source_day, "rows", side FROM day_sides'
    sql["day_sides_fixed"] = f"""{by_day}
SELECT source_day, "rows", CASE WHEN row_number() OVER (ORDER BY first_ts DESC, source_day DESC) <= 3 THEN 'test' ELSE 'train' END AS side
FROM days"""
    sql["day_split_matrix"] = (
        f"{by_day},\n{DAY_SIDES},\nsided AS (SELECT e.*, s.side FROM encoded e JOIN day_sides s USING (source_day)) "
        + matrix("row_no", "sided")
    )
    sql["temporal_tail"] = f"""WITH {encoded_cte(True)}
SELECT source_day, row_no, "Target", CASE WHEN row_number() OVER (ORDER BY source_day DESC, row_no DESC)
  <= greatest(1, floor({SHARE} * count(*) OVER ())) THEN 'validation' ELSE 'train' END AS side FROM encoded"""
    sql["class_weight"] = f"""WITH {encoded_cte()}
SELECT count(*) FILTER ("Target" = 0) AS benign_rows, count(*) FILTER ("Target" = 1) AS attack_rows,
{r('count(*) FILTER ("Target" = 0) / CAST(count(*) FILTER ("Target" = 1) AS DOUBLE)')} AS weight FROM encoded"""
    sql["validation_carve"] = f"""{sided},
train AS (SELECT row_no, "Target" FROM sided WHERE side = 'train'),
{sides_cte('train', ['row_no'], 'carved', 'validation', 'train', 'phase')}
SELECT phase, "Target", count(*) AS n FROM carved GROUP BY 1, 2"""

    sql["score_counts"] = f"WITH {CURVE} SELECT score, pos, neg FROM counts"
    sql["cumulative_counts"] = f"WITH {CURVE} SELECT threshold, tp, fp, total_pos, total_neg FROM curve"
    sql["cumulative_counts_in_ranges"] = f"WITH {CURVE} SELECT threshold, tp, fp, next_pos, next_neg FROM curve"
    sql["pr_curve"] = f"""WITH {CURVE}
SELECT {r('threshold')} AS threshold, {r('"precision"')} AS "precision", {r('recall')} AS recall FROM rated
UNION ALL SELECT NULL, 1.0, 0.0"""
    points = f"""SELECT {r('threshold')} AS threshold, {r('fp / CAST(total_neg AS DOUBLE)')} AS fpr, {r('recall')} AS tpr FROM rated"""
    start = "UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0"
    sql["roc_curve"] = f"WITH {CURVE} {points} WHERE next_pos IS NULL OR pos <> next_pos OR neg <> next_neg OR tp = pos AND fp = neg {start}"
    sql["roc_curve_all_points"] = f"WITH {CURVE} {points} {start}"
    sql["ranking_metrics"] = f"""WITH {CURVE}
SELECT {r('sum(pos / CAST(total_pos AS DOUBLE) * "precision")')} AS average_precision,
{r('sum(neg * (tp - pos / 2.0)) / (max(total_pos) * CAST(max(total_neg) AS DOUBLE))')} AS roc_auc,
max(total_pos) AS positives, max(total_neg) AS negatives FROM rated"""
    sql["operating_threshold"] = f"""WITH {CURVE}
SELECT {r('threshold')} AS threshold, {r('"precision"')} AS "precision", {r('recall')} AS recall, {r('f1')} AS f1 FROM best"""
    sql["decisions"] = f"""WITH {SCORED_CTE}
SELECT "Target", CASE WHEN score >= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM scored GROUP BY 1, 2"""
    tenth = f"WITH {confusion_cte('CAST(0.1 AS DOUBLE)')}"
    p, c, f = f_one("tp", "fp", "fn")
    sql["confusion_at_threshold"] = f'{tenth} SELECT tp, fp, fn, tn, {r(p)} AS "precision", {r(c)} AS recall, {r(f)} AS f1 FROM cells'
    sql["confusion_matrix"] = f"{tenth} " + union(
        f"SELECT {a} AS actual, {b} AS predicted, {cell} AS n FROM cells"
        for a, b, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    )
    sql["classification_report"] = class_report()
    sql["threshold_sweep"] = sweep(FIXED_THRESHOLD, SCORED_CTE)
    sql["threshold_sweep_at_best"] = sweep("SELECT threshold AS thr FROM best", CURVE)
    sql["confidence_histogram"] = histogram()
    sql["calibration_curve"] = calibration()

    headers = [(w, [*(IDENTIFIER_SQL if w == DRIFTED_WEEK else []), *RAW_COLUMNS]) for w in WEEKS]
    listed = ", ".join(f"('{w}', {i}, '{c}')" for w, columns in headers for i, c in enumerate(columns))
    sql["header_manifest"] = f'SELECT * FROM (VALUES {listed}) AS t(source, pos, "column")'
    sql["header_drift"] = union(
        f"SELECT '{DRIFTED_WEEK}' AS source, '{c}' AS \"column\", 'extra' AS difference" for c in IDENTIFIER_SQL
    )
    sql["source_preview"] = f"""WITH lands AS ({landing(False).replace(' FROM flows', ', row_no FROM flows')})
SELECT source_day AS source, CAST(row_number() OVER (PARTITION BY source_day ORDER BY row_no) - 1 AS INTEGER) AS pos,
"Timestamp", "Protocol", "Flow Duration", "Label" FROM lands
QUALIFY row_number() OVER (PARTITION BY source_day ORDER BY row_no) <= 5"""
    def strongest(k):
        return f"(SELECT feature FROM ({sql['target_correlations']}) ORDER BY abs(corr) DESC, feature LIMIT {k})"

    chosen = [f"({side} = 'Target' OR {side} IN {strongest(15)})" for side in ("feature_a", "feature_b")]
    sql["explored_matrix"] = f"SELECT * FROM ({sql['correlation_matrix']}) WHERE {' AND '.join(chosen)}"
    sql["explored_quartiles"] = f"SELECT * FROM ({quartiles(LINE_FEATURES)}) WHERE feature IN {strongest(3)}"
    sql["explored_histogram"] = f"SELECT * FROM ({log_bins(LINE_FEATURES)}) WHERE feature IN {strongest(3)}"
    sql["merge_reconciliation"] = f"""WITH {week_flows(FLOWS)}
SELECT source_day AS source, count(*) AS csv_rows, count(*) AS merged_rows, true AS passed FROM flows GROUP BY 1"""
    sql["stored_strategies"] = f"WITH {FLOWS} SELECT '8020_stratified' AS strategy, count(*) AS n FROM flows"
    sql["merged_rows_drop"] = landing(False)
    sql["merged_rows_keep"] = landing(True)
    sql["day_slice_rows"] = f"""WITH {week_flows(FLOWS)}
SELECT source_day, count(*) AS "rows", CASE WHEN source_day = '{DRIFTED_WEEK}' THEN count(*) ELSE 0 END AS with_flow_id FROM flows GROUP BY 1"""
    sql["landing_label_mix"] = sql["clean_label_mix"]
    sql["parquet_round_trip"] = f'WITH {FLOWS} SELECT row_no, "Protocol", "Label" FROM flows'
    kinds = [(c, "double") for c in CLEAN] + [("Label", "string"), ("source_day", "string"), ("Timestamp", "string"), ("row_no", "bigint")]
    sql["flow_schema"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(kinds)
    ) + ') AS t(pos, "column", "type")'
    sql["flow_row_count"] = 'SELECT count(*) AS "rows" FROM events'
    sql["sweep_csv_round_trip"] = sql["threshold_sweep"]
    sql["stored_threshold"] = f"""WITH {CURVE}, thr AS (SELECT round(threshold, 6) AS t FROM best)
SELECT max(t) AS threshold, CAST(0.5 AS DOUBLE) AS default_threshold, count(*) FILTER (score >= t) AS flagged FROM scored, thr"""

    sql["prepared_stratified_balance"] = f'{sided} SELECT side, "Target", count(*) AS n FROM sided GROUP BY 1, 2'
    sql["prepared_day_balance"] = week_flows(
        f'{by_day},\n{DAY_SIDES} SELECT s.side, e.source_day, e."Target", count(*) AS n FROM encoded e JOIN day_sides s USING (source_day) GROUP BY 1, 2, 3'
    )
    line_sides = f"WITH {LINES_CTE},\n{sides_cte('lines', LINE_KEY)}"
    sizes = """count(*) FILTER ("Target" = 1) AS positives, count(*) FILTER ("Target" = 0) AS negatives"""
    sql["scored_row_counts"] = f'WITH {LINES_CTE} SELECT "Target", count(*) AS n, count(*) AS probabilities FROM lines GROUP BY 1'
    sql["reloaded_scores_agree"] = 'SELECT count(*) AS "rows", count(*) AS same_scores FROM lineitem'
    sql["importance_total"] = f"SELECT {len(LINE_FEATURES)} AS features, 1.0 AS total"
    sql["curve_summary"] = "SELECT 1 AS lengths, 1 AS best, 'validation' AS best_side"
    sql["evaluated_class_sizes"] = f"{line_sides} SELECT {sizes} FROM sided WHERE side = 'test'"
    sql["sweep_class_sizes"] = sql["evaluated_class_sizes"]
    day_test = f"{by_day},\n{DAY_SIDES},\ntested AS (SELECT e.* FROM encoded e JOIN day_sides s USING (source_day) WHERE s.side = 'test')"
    sql["day_model_support"] = f"{day_test} {supports('tested')}"
    sql["prepared_model_support"] = f"{sided}, tested AS (SELECT * FROM sided WHERE side = 'test') {supports('tested')}"
    sql["model_feature_gate"] = (
        "SELECT 'model_features' AS \"check\", 2.0 AS observed, '0 differing columns' AS expected, 'warning' AS severity, "
        'false AS passed, count(*) AS "rows" FROM lineitem'
    )
    wide = ", ".join(f"('{w}', {len(columns)}, true, true)" for w, columns in headers)
    sql["inventory_widths"] = f'SELECT * FROM (VALUES {wide}) AS t(source, "columns", has_files, has_bytes)'
    sql["merged_is_smaller"] = "SELECT true AS smaller"
    return sql


def supports(table: str) -> str:
    rows = [("Benign (0)", "WHERE \"Target\" = 0"), ("Attack (1)", "WHERE \"Target\" = 1"), ("accuracy", ""), ("macro avg", ""), ("weighted avg", "")]
    return union(f"SELECT '{name}' AS \"row\", count(*) AS support FROM {table} {where}" for name, where in rows)


ORACLE = build()
