import pytest
from pyspark.sql import functions as F

from flowsift.plans import preparation
from flowsift.schema import SOURCE_ORDER, TIME_BASED
from flowsift.sources import csv_days as s, tables
from tests.plans import plan_of, rows


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()

    def write(**files):
        for name, text in files.items():
            (folder / f"{name}.csv").write_text(text)
        return str(folder)

    return write


DRIFTED = {"day1": "A, B,Label\n1,2,x\n3,4,y\n", "day2": "X,A, B,Label\n9,5,6,z\n", "day3": "A, B,Label\n7,NA,\n"}


def test_headers_and_inventory(spark, landing):
    folder = landing(**DRIFTED)
    sources = s.list_sources(spark, folder)
    assert s.headers_of(sources) == {"day1": ["A", "B", "Label"], "day2": ["X", "A", "B", "Label"], "day3": ["A", "B", "Label"]}
    found = s.inventory(spark, folder, sources).collect()
    assert [(r["source"], r["files"], r["bytes"], r["columns"]) for r in found] == [
        (name, 1, len(text), 4 if name == "day2" else 3) for name, text in DRIFTED.items()
    ]
    assert s.header_manifest(spark, sources).count() == 10


def test_drop_and_keep(spark, landing):
    sources = s.list_sources(spark, landing(**DRIFTED))
    dropped = s.merge_sources(spark, sources, "drop")
    assert dropped.columns == ["source_day", *SOURCE_ORDER, "A", "B", "Label"]
    assert rows(dropped.select("source_day", "A", "B", "Label")) == sorted(
        [("day1", "1", "2", "x"), ("day1", "3", "4", "y"), ("day2", "5", "6", "z"), ("day3", "7", None, None)], key=repr
    )
    kept = s.merge_sources(spark, sources, "keep")
    assert rows(kept.select("X", "A", "B", "Label")) == sorted(
        [(None, "1", "2", "x"), (None, "3", "4", "y"), ("9", "5", "6", "z"), (None, "7", None, None)], key=repr
    )
    assert {kind for name, kind in kept.dtypes if name in "XAB"} == {"string"}
    with pytest.raises(ValueError):
        s.merge_sources(spark, sources, "ask")


def test_scans_follow_headers_not_files(spark, landing):
    texts = {f"d{i:02}": "A,B\n1,2\n" for i in range(12)} | {"wide": "A,B,C\n1,2,3\n"}
    sources = s.list_sources(spark, landing(**texts))
    assert plan_of(s.merge_sources(spark, sources)).count("FileScan") == 2


def test_drift_rules(spark):
    def of(headers):
        return [s.Source(n, n, n, tuple(c), "") for n, c in headers.items()]

    def found(headers):
        return {(r["source"], r["column"], r["difference"]) for r in s.header_drift(s.header_manifest(spark, of(headers))).collect()}

    assert found({"a": ["p", "q"], "b": ["p", "q", "r"], "c": ["p", "z"]}) == {("b", "r", "extra"), ("c", "z", "extra"), ("c", "q", "missing")}
    assert s.merged_columns(spark, of({"a": ["p", "q"], "b": ["p", "q", "r"], "c": ["p", "z"]})) == ["p", "q"]
    assert s.merged_columns(spark, of({"a": ["p"], "b": ["p", "r"], "c": ["r", "p"]}), "keep") == ["p", "r"]
    assert s.merged_columns(spark, of({"b": ["p", "r"], "a": ["p", "r"], "c": ["y", "p", "x", "r"]}), "keep") == ["p", "r", "y", "x"]
    # a tie between widths goes to the first source by name
    assert s.merged_columns(spark, of({"b": ["p", "r"], "a": ["q"]})) == ["q"]
    with pytest.raises(ValueError):
        s.merged_columns(spark, of({"a": ["p"]}), "merge")


def test_headers_are_named_as_the_reader_names_them(spark, landing):
    folder = landing(odd='A,"b ""x"", c",,a,D\n1,2,3,4,5\n', empty="")
    paths = {p: f"{folder}/{p}.csv" for p in ("odd", "empty")}
    assert s.read_header(spark, paths["odd"]) == tuple(spark.read.options(**s.CSV_OPTIONS).csv(paths["odd"]).columns)
    assert s.read_header(spark, paths["empty"]) == ()


def test_drift_inside_a_source_fails(spark, tmp_path):
    folder = tmp_path / "landing" / "day1.csv"
    folder.mkdir(parents=True)
    (folder / "part-0.csv").write_text("A,B\n1,2\n")
    (folder / "part-1.csv").write_text("B,A\n2,1\n")
    sources = s.list_sources(spark, str(tmp_path / "landing"))
    assert [x.name for x in sources] == ["day1"]
    with pytest.raises(Exception, match="header"):
        s.merge_sources(spark, sources).collect()


def test_row_order_over_many_splits(spark, landing):
    n = 4000
    folder = landing(day1="v,Label\n" + "".join(f"{i},x\n" for i in range(n)), day2="v,Label\n-1,y\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        merged = s.merge_sources(spark, s.list_sources(spark, folder))
        blocks = merged.filter("source_day = 'day1'").select("source_block").distinct().count()
        got = [int(r["v"]) for r in merged.orderBy(*SOURCE_ORDER).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 5 and got == [*range(n), -1]


def test_quotes_and_blanks_survive(spark, landing):
    folder = landing(day1='A,Label\n"a ""b"", c", Bot \n')
    assert rows(s.merge_sources(spark, s.list_sources(spark, folder)).select("A", "Label")) == [('a "b", c', " Bot ")]


def test_preview(spark, landing):
    folder = landing(day1="A\n" + "".join(f"{i}\n" for i in range(50)), day2="A\n8\n")
    found = s.preview_table(spark, s.list_sources(spark, folder), ["A"])
    assert rows(found) == [("day1", i, str(i)) for i in range(5)] + [("day2", 0, "8")]


def test_day_slices_and_sizes(spark, landing, tmp_path):
    folder, out = landing(**DRIFTED), str(tmp_path / "days")
    preparation.merge_job(spark, folder, out, TIME_BASED, widths=(3, 4))
    back = tables.read_parquet(spark, out)
    assert sorted(p.name for p in (tmp_path / "days").glob("source_day=*")) == [f"source_day=day{i}" for i in (1, 2, 3)]
    assert set(back.columns) == {"source_day", *SOURCE_ORDER, "A", "B", "Label", "X"}
    sizes = s.size_comparison(spark, folder, out).first()
    assert sizes["csv_files"] == 3 and sizes["csv_bytes"] == sum(map(len, DRIFTED.values()))
    assert sizes["parquet_bytes"] == sum(p.stat().st_size for p in (tmp_path / "days").rglob("*.parquet"))


def test_parquet_reads_only_named_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet(spark.range(10).select("id", F.lit("x").alias("Flow Byts/s"), F.lit(1).alias("c")), path)
    df = tables.read_parquet(spark, path, ["Flow Byts/s"])
    assert "ReadSchema: struct<Flow Byts/s:string>" in plan_of(df)
    assert tables.row_count(tables.read_parquet(spark, path)).first()[0] == 10
    assert "ReadSchema: struct<>" in plan_of(tables.row_count(tables.read_parquet(spark, path)))
    assert rows(tables.schema_table(df)) == [(0, "Flow Byts/s", "string")]


def test_threshold_store(spark, tmp_path):
    path = str(tmp_path / "threshold")
    assert tables.load_threshold(spark, path) == 0.5
    tables.save_threshold(spark, path, 0.12345678)
    assert tables.load_threshold(spark, path) == 0.123457


def test_csv_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(0.5, " padded ", True)], "t double, s string, b boolean")
    tables.write_csv(df, path)
    assert rows(tables.read_csv(spark, path, "t double, s string, b boolean")) == rows(df)


def test_equal_names_in_two_folders_are_two_sources(spark, landing, tmp_path):
    folder = landing(top="A,B\n1,2\n")
    for name, text in (("a", "A,B\n3,4\n5,6\n"), ("b", "A,B\n7,8\n")):
        (tmp_path / "landing" / name).mkdir()
        (tmp_path / "landing" / name / "day.csv").write_text(text)
    sources = s.list_sources(spark, folder)
    assert [x.name for x in sources] == ["a/day", "b/day", "top"]
    merged = s.merge_sources(spark, sources)
    assert sorted(r["A"] for r in merged.collect()) == ["1", "3", "5", "7"]
    assert {(r["source_day"], r["source_file"]) for r in merged.collect()} == {("a/day", "a/day.csv"), ("b/day", "b/day.csv"), ("top", "top.csv")}
    report = s.merge_reconciliation(spark, sources, merged)
    assert rows(report) == [("a/day", 2, 2, True), ("b/day", 1, 1, True), ("top", 1, 1, True)]
    lost = s.merge_reconciliation(spark, sources, merged.filter("A <> '7' AND A <> '3'"))
    assert rows(lost) == [("a/day", 2, 1, False), ("b/day", 1, 0, False), ("top", 1, 1, True)]


def test_folders_with_blanks_and_percent_signs(spark, tmp_path):
    folder = tmp_path / "landing 100%+"
    folder.mkdir()
    (folder / "day one.csv").write_text("A\n1\n")
    sources = s.list_sources(spark, str(folder))
    assert [r["source_day"] for r in s.merge_sources(spark, sources).collect()] == [x.name for x in sources] == ["day one"]


def test_a_manifest_saves_opening_known_sources(spark, landing, tmp_path, monkeypatch):
    folder, manifest, opened = landing(**DRIFTED), str(tmp_path / "manifest"), []
    read = s.read_header
    monkeypatch.setattr(s, "read_header", lambda spark, path: opened.append(path.rsplit("/", 1)[1]) or read(spark, path))
    first = s.list_sources(spark, folder, manifest)
    assert sorted(opened) == ["day1.csv", "day2.csv", "day3.csv"]
    landing(day4="A, B,Label\n1,2,z\n", day1="A, B,Label\n1,2,x\n")  # one new, one of another size
    opened.clear()
    again = s.list_sources(spark, folder, manifest)
    assert sorted(opened) == ["day1.csv", "day4.csv"]
    assert again[:3] == first and again == s.list_sources(spark, folder)
    opened.clear()
    assert s.list_sources(spark, folder, manifest) == again and opened == []
