import pytest

from strataprobe.errors import NoValidValues
from strataprobe.functions.names import suggests_place
from strataprobe.operators import spatial


@pytest.mark.parametrize(("name", "yes"), [("latitude", True), ("platform", True), ("x_coord", True), ("city", True), ("price", False)])
def test_names(name, yes):
    assert suggests_place(name) is yes


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("52.1", 4.5, True), (None, 5.5, False), ("53.3", None, True), ("bad", 200.0, None), ("12d", float("nan"), None)], "lat string, lon double, f boolean")


def test_extent_drops_each_column_on_its_own(points):
    r = spatial.spatial_extent(points, "lat", "lon").first()
    assert (r.valid_point_count, r.min_lat, r.max_lat, r.min_lon, r.max_lon) == (2, 52.1, 53.3, 4.5, 200.0)
    assert r.min_lat <= r.center_lat <= r.max_lat and r.warnings == ["longitude values outside [-180, 180]"]


def test_no_valid_point(spark):
    with pytest.raises(NoValidValues):
        spatial.checked_spatial_extent(spark.createDataFrame([("a", "b")], "x string, y string"), "x", "y")


def test_coordinate_types(spark, points):
    got = {r.field: r.detected_type for r in spatial.coordinate_types(points).collect()}
    assert got == {"lon": None, "f": "possible_latitude"}
    wide = spark.createDataFrame([(100, None), (-179, None)], "a int, e long")
    assert {r.field: r.detected_type for r in spatial.coordinate_types(wide).collect()} == {"a": "possible_longitude", "e": None}


def test_detection_and_pairs(spark):
    df = spark.createDataFrame([("POINT(1 2)", 52.0, 104.0, "x")], "geom string, lat double, lon double, price string")
    found = spatial.detect_spatial_columns(df)
    assert {r.field: r.detected_type for r in found.collect()} == {"geom": "wkt_geometry", "lat": "possible_latitude", "lon": "possible_longitude"}
    assert [(r.latitude, r.longitude) for r in spatial.coordinate_pairs(found, df.columns).collect()] == [("lat", "lon")]


@pytest.mark.parametrize(("good", "wkt"), [(50, False), (51, True)])
def test_wkt_share(spark, good, wkt):
    df = spark.createDataFrame([("point (1 1)" if i < good else "no",) for i in range(100)], "g string").coalesce(1)
    assert (spatial.wkt_share(df, "g", 100) > spatial.WKT_SHARE) is wkt


def test_wkt_types(spark):
    kinds = ["POINT(0 0)", " point (1 1)", "LINESTRING(0 0,1 1)", "MULTIPOLYGON(((0 0)))", "GEOMETRYCOLLECTION(POINT(0 0))", None, "POLYGON((0 0))"]
    df = spark.createDataFrame([(k,) for k in kinds], "g string")
    assert {r.wkt_type: r.n for r in spatial.wkt_types(df, "g").collect()} == {"POINT": 2, "LINESTRING": 1, "MULTIPOLYGON": 1, "POLYGON": 1}
    r = spatial.analyze_spatial_column(df, "g").first()
    assert r.format == "WKT" and r.wkt_types["POINT"] == 2 and r.null_count == 1


def test_analysis_of_numbers(spark):
    r = spatial.analyze_spatial_column(spark.createDataFrame([(1000.0,), (-5.0,)], "e double"), "e").first()
    assert (r.min, r.max, r["mean"], r.coordinate_hint) == (-5.0, 1000.0, 497.5, "projected_or_other")
