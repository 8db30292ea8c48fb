import pytest
from pyspark.sql import functions as F

from fallow.plans import curves, maps
from fallow.sources import results, tables


def write(path, text, bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())
    return str(path)


def test_water_csv(spark, tmp_path):
    corn = write(tmp_path / "corn.csv", "GEOID,Yr,avg_corn,range_corn,volume\n20001,0,1.5,2,12.5\n20003,1,1,1,abc\n", bom=True)
    soy = write(tmp_path / "soy.csv", "GEOID,Yr,avg_beans,range_beans,volume\n20001,0,3,4,7\n")
    got = tables.read_water_csv(spark, {"corn": corn, "soy": soy})
    assert got.columns == ["GEOID", "Yr", "avg_water", "range_water", "volume", "crop"]
    assert {tuple(r) for r in got.collect()} == {
        ("20001", 0, 1.5, 2.0, "12.5", "corn"), ("20003", 1, 1.0, 1.0, "abc", "corn"), ("20001", 0, 3.0, 4.0, "7", "soy")
    }


def test_expense_csv(spark, tmp_path):
    path = write(tmp_path / "f.csv", '"","2008","2009"\n20001,2.5,NA\n20003,1,3\n')
    got = tables.read_expense_csv(spark, path)
    assert got.columns == ["X", "X2008", "X2009"]
    assert {tuple(r) for r in got.collect()} == {("20001", 2.5, None), ("20003", 1.0, 3.0)}
    assert tables.year_headers(got, 2008, 2018) == ["X2008", "X2009"]


def test_panels_and_stages(spark, tmp_path):
    for crop, n in (("corn", 3), ("soy", 2)):
        spark.range(n).withColumnRenamed("id", "GEOID").write.parquet(str(tmp_path / crop))
    panel = tables.read_crop_panels(spark, {c: str(tmp_path / c) for c in ("corn", "soy")})
    assert dict(panel.dtypes)["GEOID"] == "string"
    tables.write_stage(panel, str(tmp_path / "stage"))
    assert tables.read_stage(spark, str(tmp_path / "stage")).count() == 5
    one = tables.read_stage(spark, str(tmp_path / "stage"), "soy")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(crop" in one._jdf.queryExecution().toString()


def test_csv_with_row_numbers(spark, tmp_path):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"), F.lit("v").alias("v")).repartition(5)
    tables.write_csv(df, str(tmp_path / "out"), ["k"])
    got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert got.columns == ["row_id", "k", "v"]
    assert got.where("row_id <> k + 1").count() == 0 and got.count() == 50


def test_row_numbers_follow_many_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(5)
    got = tables.with_row_id(df, ["k"], range_rows=20)
    assert got.where("row_id <> k + 1").count() == 0 and got.count() == 500
    assert tables.with_row_id(df.limit(0), ["k"]).count() == 0


def test_results_by_model(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "model_id string, dic double")
    path = str(tmp_path / "fits")
    results.save_results({"fit_model": df}, path)
    results.save_results({"fit_model": df.where("model_id = 'b'").withColumn("dic", F.lit(9.0))}, path)
    got = results.load_results(spark, path, "fit_model")
    assert {(r.model_id, r.dic) for r in got.collect()} == {("a", 1.0), ("a", 2.0), ("b", 9.0)}
    one = results.load_results(spark, path, "fit_model", "b")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(model_id" in one._jdf.queryExecution().toString()
    wanted = spark.createDataFrame([("b",), ("missing",)], "model_id string")
    assert [r.model_id for r in curves.fitted_only(wanted, got).collect()] == ["b"]
    with pytest.raises(ValueError):
        results.save_results({"other": df}, path)


def test_labels(spark):
    effects = spark.createDataFrame(
        [("wheat", "f", "aveSIDI2yr", 0.5, -1.0, 0.1, 1.0), ("corn", "f", "covfert", 5.0, -1.0, 0.1, 1.0)],
        "crop string, family string, term string, x double, q025 double, q50 double, q975 double",
    )
    got = {r.Crop: r for r in curves.curves_across_crops(effects, {"f": "dyield"}, ["aveSIDI2yr", "covfert"]).collect()}
    assert got["Winter wheat"].label == "Average Diversity (2 years)"
    assert got["Corn"].label == "Coefficient of Variation \n for Fertlizer"
    assert got["Corn"].effect_on == "Effect on dyield"
    assert got["Winter wheat"].in_view and not got["Corn"].in_view


def test_map_has_one_row_per_area(spark):
    corners = [(g, 20 if g != "z" else 19, 1, 1, s, float(s), 0.0) for g in "abz" for s in range(3)]
    county = spark.createDataFrame(corners, tables.POLYGON_SCHEMA)
    panel = spark.createDataFrame([("corn", "a", 1, y) for y in range(4)], "crop string, GEOID string, CNTY int, YEAR int")
    effects = spark.createDataFrame([("m", "CNTY", 1, 0.5, 0.1)], "model_id string, term string, level int, mean double, sd double")
    got = {r.GEOID: r for r in maps.area_effect_map(county, panel, effects, "corn", "m", 20).collect()}
    assert set(got) == {"a", "b"} and got["a"].Mean == 0.5 and got["b"].Mean is None
    assert len(got["b"].geometry) == 3


def test_damaged_lines_are_set_aside(spark, tmp_path):
    from fallow.sources import tables

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.csv").write_text('id,n,x,s\n1,2,0.5,a\n2,zwei,0.5,b\n3,4\n,5,1.5,c\n5,,,\n6,7,8,9,10\n7,1,nan,"q, r"\n')
    rows, rejected = tables.read_checked_csv(spark, str(tmp_path / "w"), "id long, n int, x double, s string", ["id"])
    got = sorted((r.id, r.n, r.s) for r in rows.collect())
    assert got == [(1, 2, "a"), (5, None, None), (7, 1, "q, r")]
    assert rows.schema.simpleString() == "struct<id:bigint,n:int,x:double,s:string>"
    bad = {r.reason: (r.id, r.n) for r in rejected.collect()}
    assert bad["n: not int"] == ("2", "zwei") and bad["id: missing"] == (None, "5")
    assert rejected.where("reason = 'wrong number of fields'").count() == 2
    assert {r.file for r in rejected.collect()} == {"w"}
