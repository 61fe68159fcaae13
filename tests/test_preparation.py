from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowsift.operators.boosting import BoostingParams
from flowsift.operators import gates
from flowsift.operators.gates import GateError
from flowsift.operators.split import feature_columns
from flowsift.plans import preparation as p, training
from flowsift.schema import ROW_KEY, STRATIFIED, TIME_BASED
from flowsift.session import shared_root

HEADER = "Dst Port,Protocol,Timestamp,Flow Duration,Flow IAT Min,Flow Byts/s,Label\n"


WIDTH = HEADER.count(",") + 1


def day_text(day, rows, start=0):
    lines = [
        f"80,{(6, 17)[i % 2]},{day:02}/03/2018 {8 + i // 60:02}:{i % 60:02}:00,{start + i},{-i},{i % 7},{'Bot' if i % 3 else 'Benign'}\n"
        for i in range(rows)
    ]
    return HEADER + "".join(lines)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text(day_text(3, 40))
    (folder / "b.csv").write_text(day_text(1, 100, 1000) + HEADER)
    (folder / "c.csv").write_text(day_text(2, 60, 5000))
    return str(folder)


def run(spark, landing, tmp_path, strategy, **options):
    paths = [str(tmp_path / name) for name in ("merged", "cleaned", "encoded", "split")]
    p.merge_job(spark, landing, paths[0], strategy, manifest=str(tmp_path / "headers"), widths=(WIDTH, WIDTH))
    p.clean_job(spark, paths[0], paths[1], strategy, width=5 if strategy == STRATIFIED else 6, labels=2)
    p.encode_job(spark, paths[1], paths[2], strategy)
    p.split_job(spark, paths[2], paths[3], strategy, **options)
    return spark.read.parquet(paths[3])


def test_stratified(spark, landing, tmp_path):
    out = run(spark, landing, tmp_path, STRATIFIED)  # one row of the 40 held out weighs 2.5 points
    assert out.count() == 200
    assert out.filter("side = 'test'").count() == 40
    assert out.select(ROW_KEY).distinct().count() == 200
    assert feature_columns(out, [ROW_KEY]) == ["Flow_Duration", "Flow_IAT_Min", "Flow_Byts_s", "Protocol_0", "Protocol_6", "Protocol_17"]


def test_the_last_days_in_time_are_the_test_side(spark, landing, tmp_path):
    out = run(spark, landing, tmp_path, TIME_BASED)
    sides = {r["source_day"]: r["side"] for r in out.select("source_day", "side").distinct().collect()}
    assert sides == {"b": "train", "c": "train", "a": "test"}  # a holds 40 of 200 rows and the latest day
    two = run(spark, landing, tmp_path / "two", TIME_BASED, test_days=2)
    assert two.filter("side = 'test'").count() == 100
    assert set(feature_columns(out, p.PLACE)) == {"Flow_Duration", "Flow_IAT_Min", "Flow_Byts_s", "Protocol_0", "Protocol_6", "Protocol_17"}


def test_few_files_per_day(spark, landing, tmp_path):
    run(spark, landing, tmp_path, TIME_BASED)
    for day in (tmp_path / "cleaned").glob("source_day=*"):
        assert len(list(day.glob("*.parquet"))) == 1


def test_gates_stop_a_job(spark, landing, tmp_path):
    run(spark, landing, tmp_path, STRATIFIED)
    with pytest.raises(GateError, match="label_count"):
        p.clean_job(spark, str(tmp_path / "merged"), str(tmp_path / "other"), STRATIFIED, width=5)
    with pytest.raises(GateError, match="known_width"):
        p.merge_job(spark, landing, str(tmp_path / "out"))
    with pytest.raises(GateError, match="row_count"):
        p.merge_job(spark, landing, str(tmp_path / "out"), rows=10**6, widths=(WIDTH, WIDTH))
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        p.merge_job(spark, str(tmp_path / "empty"), str(tmp_path / "out"))
    cleaned = spark.read.parquet(str(tmp_path / "cleaned")).withColumn("Dst_Port", F.lit(1.0))
    cleaned.write.parquet(str(tmp_path / "leaky"))
    with pytest.raises(GateError, match="leaking_columns"):
        p.encode_job(spark, str(tmp_path / "leaky"), str(tmp_path / "out"), STRATIFIED)


def test_a_manifest_is_kept_by_the_job(spark, landing, tmp_path):
    run(spark, landing, tmp_path, STRATIFIED)
    assert spark.read.parquet(str(tmp_path / "headers")).count() == 3


def test_gates_see_a_table_while_it_is_written(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).selectExpr("cast(id as double) x", "if(id = 7, null, cast(id as double)) y")
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    with pytest.raises(GateError, match="rows_with_missing_cells: observed 1"):
        p.write_gated(df.mapInArrow(counted, df.schema), gates.encoded_checks(df), "encoded", str(tmp_path / "t"))
    assert scans.value == 1000  # written and checked in one pass
    none = spark.createDataFrame([], df.schema)
    p.write_gated(none, gates.encoded_checks(none), "encoded", str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_a_stored_split_is_trained_on_and_leaves_no_scratch(spark, landing, tmp_path):
    run(spark, landing, tmp_path, TIME_BASED)
    small = BoostingParams(max_trees=3, max_depth=2)
    root = Path(shared_root(spark).removeprefix("file://")) / "flowsift"
    before = set(root.glob("*")) if root.exists() else set()
    found = training.train_job(spark, str(tmp_path / "split"), str(tmp_path / "run"), TIME_BASED, small)
    assert set(root.glob("*")) == before
    assert found.report.filter("row = 'accuracy'").first()["support"] == 40 == found.scores.count()
    assert "day_start" not in found.features and ROW_KEY not in found.features
