"""Layers with attributes, one pass over files, tables that cannot be read, one file for each key."""

import json
import os
import sqlite3
import struct
import threading
from decimal import Decimal

import maker
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.plans import convert
from cartolith.plans.validate import findings
from cartolith.sources import gpkg, shapefile
from cartolith.sources.gpkg import Container, FilePart, LayerReader, PushedLayerReader

AS_OF = "2026-12-31T00:00:00Z"
WELLS = ["ALTER TABLE wells ADD COLUMN depth DOUBLE", "ALTER TABLE wells ADD COLUMN n MEDIUMINT", "ALTER TABLE wells ADD COLUMN open BOOLEAN", "ALTER TABLE wells ADD COLUMN dug DATE", "ALTER TABLE wells ADD COLUMN seen DATETIME",
         "UPDATE wells SET depth = fid * 1.5, n = fid * 10, open = fid % 2, dug = '2024-02-0' || fid, seen = '2024-02-03T04:05:06Z'"]


@pytest.fixture(scope="module")
def wells(tmp_path_factory):
    d = tmp_path_factory.mktemp("wells")
    maker.make(d / "a.gpkg", "survey", *WELLS)
    maker.make(d / "b.gpkg", "survey")
    return str(d)


def name(rows):
    return sorted((os.path.basename(r.file), *tuple(r)[1:]) for r in rows)


def test_layer_has_typed_attributes(spark, wells):
    df = gpkg.read_layer(spark, wells, "wells")
    assert dict(df.dtypes) == {"file": "string", "fid": "bigint", "geom": "binary", "remark": "string", "depth": "double", "n": "int", "open": "boolean", "dug": "date", "seen": "timestamp"}
    rows = {(os.path.basename(r.file), r.fid): r for r in df.collect()}
    assert len(rows) == 8 and bytes(rows["a.gpkg", 2].geom) == maker.point(11, 50)
    r = rows["a.gpkg", 3]
    assert (r.remark, r.depth, r.n, r.open, str(r.dug)) == ("r3", 4.5, 30, True, "2024-02-03") and rows["b.gpkg", 3].depth is None
    with pytest.raises(Exception, match="no layer moors"):
        gpkg.read_layer(spark, wells, "moors")


def schema_of(spark, wells, columns):
    return gpkg.read_layer(spark, wells, "wells", columns=columns).schema


def test_only_wanted_columns_and_rows_are_read(spark, wells):
    reader = PushedLayerReader({"path": wells, "layer": "wells"}, schema_of(spark, wells, ["fid", "n", "remark"]))
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringStartsWith

    given = [GreaterThan(("n",), 10), EqualTo(("remark",), "r3"), In(("n",), (20, 30)), StringStartsWith(("remark",), "r"), IsNull(("n",)), GreaterThan(("n",), float("nan"))]
    assert list(reader.pushFilters(given)) == given and len(reader.conditions) == 4
    con = gpkg.open_readonly(f"{wells}/a.gpkg")
    seen = []
    con.set_trace_callback(seen.append)
    c = Container(con, FilePart(f"{wells}/a.gpkg"))
    assert list(reader._rows(c, c.part)) == [(3, 30, "r3")]
    said = [x for x in seen if x.startswith("SELECT rowid")]
    assert len(said) == 1 and "geom" not in said[0] and "depth" not in said[0] and '"n" > 10' in said[0] and "\"remark\" COLLATE BINARY = 'r3'" in said[0]
    con.close()
    df = gpkg.read_layer(spark, wells, "wells", columns=["fid", "n"]).filter("n >= 20 AND n < 40").select("fid")
    assert sorted(r.fid for r in df.collect()) == [2, 3]
    assert [r.n for r in spark.read.format("gpkg").schema("n int").options(path=f"{wells}/a.gpkg", layer="wells").load().orderBy("n").collect()] == [10, 20, 30, 40]


def test_boxes_use_the_index(spark, wells, tmp_path):
    box = (10.5, 49, 12, 51)
    got = gpkg.read_layer(spark, f"{wells}/a.gpkg", "wells", box=box, columns=["fid"])
    assert sorted(r.fid for r in got.collect()) == [2, 3]
    reader = LayerReader({"path": wells, "layer": "wells", "box": "10.5,49,12,51"}, schema_of(spark, wells, ["fid"]))
    con = gpkg.open_readonly(f"{wells}/a.gpkg")
    assert "rtree_wells_geom" in reader.statement(Container(con, FilePart("a")))[0]
    con.close()
    bare = maker.make(tmp_path / "bare.gpkg", "survey", "DROP TABLE rtree_wells_geom")
    assert sorted(r.fid for r in gpkg.read_layer(spark, str(bare), "wells", box=box, columns=["fid"]).collect()) == [2, 3]


def test_values_of_another_type_are_told(spark, tmp_path):
    p = str(maker.make(tmp_path / "odd.gpkg", "survey", *WELLS, "UPDATE wells SET n = 'many' WHERE fid = 2"))
    with pytest.raises(Exception, match="wells.n: 'many' is no int"):
        gpkg.read_layer(spark, p, "wells").collect()
    assert sorted(str(r.n) for r in gpkg.read_layer(spark, p, "wells", permissive="true").collect()) == ["10", "30", "40", "None"]


def test_layers_are_listed(spark, wells):
    got = {(os.path.basename(r.file), r.table_name): r for r in gpkg.list_layers(spark, wells).collect()}
    r = got["a.gpkg", "wells"]
    assert (r.data_type, r.srs_id, r.organization, r.code, r.geometry_column, r.geometry_type, r.n, r.max_y) == ("features", 4326, "EPSG", 4326, "geom", "POINT", 4, 60.0)
    assert [(f.name, f.type) for f in r.fields][-2:] == [("dug", "DATE"), ("seen", "DATETIME")] and set(got) == {(f, t) for f in ("a.gpkg", "b.gpkg") for t in ("wells", "tracks")}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    second = ["CREATE TABLE second (id INTEGER PRIMARY KEY, zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)", "INSERT INTO gpkg_contents SELECT 'second', data_type, 'second', '', last_change, min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents WHERE table_name = 'scene'",
              ("INSERT INTO second VALUES (1, 0, 0, 0, ?)", (maker.jpeg(512),))]
    maker.make(d / "lacking.gpkg", "imagery", "DROP TABLE scene", "CREATE TABLE scene (id INTEGER PRIMARY KEY, zoom_level INTEGER)", "INSERT INTO scene VALUES (1, 0)", *second)
    maker.make(d / "view.gpkg", "imagery", "ALTER TABLE scene RENAME TO kept", "CREATE VIEW scene AS SELECT * FROM kept")
    maker.make(d / "rowless.gpkg", "imagery", "CREATE TABLE other (id INTEGER PRIMARY KEY, zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB) WITHOUT ROWID", "INSERT INTO other SELECT * FROM scene", "DROP TABLE scene", "ALTER TABLE other RENAME TO scene")
    maker.make(d / "layer.gpkg", "survey", "ALTER TABLE wells RENAME TO kept", "CREATE VIEW wells AS SELECT * FROM kept")
    return str(d)


def test_a_table_that_cannot_be_read_stops_no_other_and_is_told(spark, odd):
    heads = gpkg.read_table(spark, odd, "__heads__", permissive="true")
    found = {(os.path.basename(r.file), r.table_name): r.n for r in heads.groupBy("file", "table_name").agg(F.count("*").alias("n")).collect()}
    assert found == {("lacking.gpkg", "second"): 1, ("view.gpkg", "scene"): 7, ("rowless.gpkg", "scene"): 7}
    with pytest.raises(Exception, match="lacking.gpkg: scene: no such column: tile_data"):
        gpkg.read_table(spark, odd, "__heads__").collect()
    for ranges in ("1", "3"):
        assert gpkg.read_table(spark, odd, "__heads__", permissive="true", ranges=ranges).count() == 15
    errors = gpkg.read_table(spark, odd, "__errors__").collect()
    assert [(os.path.basename(r.file), r.table_name) for r in errors] == [("lacking.gpkg", "scene")]
    assert gpkg.read_layer(spark, f"{odd}/layer.gpkg", "wells").count() == 4


def test_findings_say_error_for_it(spark, odd, tmp_path):
    for c in (gpkg.read_catalog(spark, odd), gpkg.read_catalog(spark, odd).written(str(tmp_path / "c"))):
        damage = {os.path.basename(r.file): r.damage for r in c.files.collect()}
        assert damage["lacking.gpkg"].startswith("scene: no such column") and damage["view.gpkg"] is None and damage["rowless.gpkg"] is None
    said = {(os.path.basename(r.file), r.req): r for r in findings(c, AS_OF).collect()}
    assert said["lacking.gpkg", 26].status == "ERROR" and "tile_data" in said["lacking.gpkg", 26].detail and said["view.gpkg", 26].status == "PASS"


def test_one_opening_gives_all_tables(spark, odd, tmp_path, monkeypatch):
    opened = []
    real = gpkg.open_readonly
    monkeypatch.setattr(gpkg, "open_readonly", lambda p: opened.append(p) or real(p))
    reader = gpkg.ScanReader({"path": odd})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sorted(opened) == gpkg.find_files(odd) and {b.column("source")[0].as_py() for b in batches} >= {"files", "heads", "features", "columns", "errors", "gpkg_contents", "schema"}
    one, many = gpkg.read_catalog(spark, odd), gpkg.read_catalog(spark, odd).written(str(tmp_path / "scan"))
    for t in ("files", "schema", "pragmas", "contents", "srs", "geometry_columns", "sets", "matrix", "extensions", "metadata", "reference", "heads", "shapes", "index", "coverage", "columns"):
        a, b = getattr(one, t), getattr(many, t)
        assert a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), t
    assert [x for x in os.listdir(tmp_path / "scan")] == ["scan"]


def test_attributes_that_say_nothing_are_told(spark, tmp_path):
    p = maker.make(tmp_path / "shell.gpkg", "survey", "UPDATE wells SET remark = CASE fid % 2 WHEN 0 THEN ' TBD ' END", "UPDATE tracks SET remark = '?' WHERE fid < 3")
    r = findings(gpkg.read_catalog(spark, str(p)).written(str(tmp_path / "c")), AS_OF).filter("req = 24").first()
    assert (r.status, r.detail) == ("PASS*", "wells.remark: null or a placeholder in all 4 rows")


def test_names_are_taken_as_they_are(spark, tmp_path):
    for n in ("a[1].gpkg", "b,c.gpkg", "d?e.gpkg", "plain.gpkg"):
        maker.make(tmp_path / n, "survey")
    for n in ("a[1].gpkg", "b,c.gpkg", "d?e.gpkg"):
        assert gpkg.find_files(str(tmp_path / n)) == [str(tmp_path / n)]
        assert gpkg.read_table(spark, str(tmp_path / n), "gpkg_contents").count() == 2
    assert len(gpkg.find_files(json.dumps([str(tmp_path / "a[1].gpkg"), str(tmp_path / "b,c.gpkg")]))) == 2
    assert len(gpkg.find_files(str(tmp_path))) == 4 and len(gpkg.find_files(f"{tmp_path}/plain.gpkg,{tmp_path}/d*.gpkg")) == 2


def test_busy_files_are_waited_for(spark, tmp_path):
    p = str(maker.make(tmp_path / "busy.gpkg", "survey"))
    con = sqlite3.connect(p, check_same_thread=False, isolation_level=None)
    con.execute("BEGIN EXCLUSIVE")
    timer = threading.Timer(4, lambda: con.execute("COMMIT"))
    timer.start()
    assert gpkg.read_table(spark, p, "gpkg_contents").count() == 2
    timer.join()
    con.close()


def squares(spark, n, parts):
    from cartolith.functions.geometry import polygon_wkb

    ring = F.array(*[F.array((F.col("id") % 50).cast("double") + a, F.floor(F.col("id") / 50).cast("double") + b) for a, b in ((0.0, 0.0), (0.9, 0.0), (0.9, 0.9), (0.0, 0.9), (0.0, 0.0))])
    return spark.range(0, n, 1, parts).select(polygon_wkb(ring).alias("geom"), F.concat(F.lit("n"), "id").alias("name"), F.lit(Decimal("12345678901234567890.123456789")).alias("exact"), (F.col("id") / 7).alias("share"))


def test_one_file_holds_all_layers_whatever_the_partitions(spark, tmp_path):
    out = str(tmp_path / "out")
    settings = dict(title="Fields", abstract="All the fields", stamp="2025-01-01T00:00:00Z", file="fields")
    got = convert.convert_layers({"squares": squares(spark, 3000, 7), "few": squares(spark, 5, 3)}, out, **settings)
    assert [(r["features"], r["lost"]) for r in got] == [(3000, 0), (5, 0)]
    assert sorted(x for x in os.listdir(out) if not x.startswith("_")) == ["fields.gpkg"]
    con = sqlite3.connect(f"{out}/fields.gpkg")
    assert con.execute("SELECT count(*) FROM squares").fetchall() == [(3000,)] and con.execute("SELECT count(*) FROM rtree_squares_geom").fetchall() == [(3000,)]
    assert con.execute("SELECT DISTINCT exact FROM squares").fetchall() == [("12345678901234567890.123456789",)]
    assert sorted(x for (x,) in con.execute("SELECT share FROM squares")) == [i / 7 for i in range(3000)]
    # Leaves of the index hold neighbours: their boxes together cover little more than the map.
    area, leaves = 0.0, con.execute("SELECT data FROM rtree_squares_geom_node WHERE nodeno IN (SELECT nodeno FROM rtree_squares_geom_rowid)").fetchall()
    for (data,) in leaves:
        cells = np.array([struct.unpack(">4f", data[12 + 24 * i : 28 + 24 * i]) for i in range(struct.unpack(">H", data[2:4])[0])])
        area += (cells[:, 1].max() - cells[:, 0].min()) * (cells[:, 3].max() - cells[:, 2].min())
    assert len(leaves) > 30 and area < 2 * 50 * 60
    con.close()
    with pytest.raises(Exception, match="files stand there"):
        convert.convert_layers({"squares": squares(spark, 3, 1)}, out, **settings)
    assert sorted(x for x in os.listdir(out) if not x.startswith("_")) == ["fields.gpkg"]
    facts = findings(gpkg.read_catalog(spark, out).written(str(tmp_path / "c")), AS_OF)
    assert facts.filter("status IN ('FAIL', 'ERROR')").collect() == []


def test_files_by_key(spark, tmp_path):
    rows = squares(spark, 100, 5).withColumn("sheet", F.concat(F.lit("s"), (F.substring("name", 2, 3).cast("int") % 3).cast("string")))
    gpkg.write_files(rows, str(tmp_path / "k"), "sheet", layer="squares", geometry_type="POLYGON")
    got = gpkg.read_layer(spark, str(tmp_path / "k"), "squares").groupBy("file").count().collect()
    assert sorted((os.path.basename(r.file), r["count"]) for r in got) == [("s0.gpkg", 34), ("s1.gpkg", 33), ("s2.gpkg", 33)]
    assert "sheet" not in gpkg.read_layer(spark, str(tmp_path / "k"), "squares").columns
    with pytest.raises(Exception, match="no name for a file"):
        gpkg.write_files(rows.withColumn("sheet", F.lit("../x")), str(tmp_path / "l"), "sheet", layer="squares")
    assert not [x for x in os.listdir(tmp_path / "l")] if (tmp_path / "l").exists() else True


def test_reports_are_of_the_job_and_failures_leave_nothing(spark, tmp_path):
    out, settings = str(tmp_path / "out"), dict(title="Fields", abstract="All the fields", stamp="2025-01-01T00:00:00Z")
    for _ in range(2):
        assert [(r["features"], r["lost"]) for r in convert.convert_layers({"squares": squares(spark, 2, 1)}, out, **settings)] == [(2, 0)]
    before = sorted(os.listdir(out))
    bad = squares(spark, 6, 3).withColumn("geom", F.when(F.col("name") == "n4", F.unhex(F.lit("01"))).otherwise(F.col("geom")))
    gpkg.register(spark)
    with pytest.raises(Exception, match="1 rows cannot be written"):
        bad.write.format("gpkg").mode("append").options(path=out, layer="squares").save()
    assert sorted(os.listdir(out)) == before


def test_geopackages_are_converted_with_their_attributes(spark, wells, tmp_path):
    out = str(tmp_path / "out")
    got = convert.convert_geopackage(spark, f"{wells}/a.gpkg", out, title="Wells and tracks", abstract="-", stamp="2025-01-01T00:00:00Z", file="one")
    assert [(r["layer"], r["features"]) for r in got] == [("tracks", 3), ("wells", 4)]
    a, b = (gpkg.read_layer(spark, p, "wells").drop("file") for p in (f"{wells}/a.gpkg", out))
    assert sorted(map(repr, a.select("fid", "geom", "remark", "depth", "n").collect())) == sorted(map(repr, b.select("fid", "geom", "remark", "depth", F.col("n").cast("int")).collect()))
    with pytest.raises(ValueError, match="no such layer: moors"):
        convert.convert_geopackage(spark, wells, out, title="x", abstract="-", stamp="2025-01-01T00:00:00Z", layers=["moors"])


def ring(x, y, size, hole=False):
    p = np.array([(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)], float)  # clockwise
    return p[::-1] if hole else p


def test_holes_belong_to_the_shell_around_them():
    a, b, inner, hole_a, hole_b = ring(0, 0, 10), ring(20, 0, 10), ring(3, 3, 4), ring(2, 2, 6, True), ring(22, 2, 2, True)
    got = shapefile.with_holes([a, b, hole_a, inner, hole_b])
    assert [[tuple(r[0]) for r in p] for p in got] == [[(0, 0), (2, 2)], [(20, 0), (22, 2)], [(3, 3)]]
    touching = shapefile.with_holes([ring(0, 0, 10), ring(10, 0, 10), ring(10, 2, 3, True)])
    assert [len(p) for p in touching] == [1, 2]


def test_tables_of_several_shapefiles(spark, tmp_path):
    def dbf(path, fields, rows):
        size = 1 + sum(w for _, _, w, _ in fields)
        head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 33 + 32 * len(fields), size)
        body = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in fields) + b"\r"
        path.write_bytes(head + body + b"".join(b" " + b"".join(str(v).rjust(w).encode() for v, (_, _, w, _) in zip(r, fields)) for r in rows))

    shp = struct.pack(">i", 9994) + b"\0" * 96
    for n, fields, rows in (("a", [("code", "N", 5, 0), ("note", "C", 5, 0)], [(7, "x")]), ("b", [("note", "C", 5, 0), ("code", "N", 6, 2), ("more", "L", 1, 0)], [("y", 1.25, "T")])):
        (tmp_path / f"{n}.shp").write_bytes(shp + struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, 3.0, 4.0))
        dbf(tmp_path / f"{n}.dbf", fields, rows)
    shapefile.register(spark)
    got = spark.read.format("shp").load(path=str(tmp_path))
    assert dict(got.dtypes) == {"file": "string", "geom": "binary", "code": "double", "note": "string", "more": "boolean"}
    assert sorted((r.code, r.note, r.more) for r in got.collect()) == [(1.25, "y", True), (7.0, "x", None)]


def test_forms_of_geojson(spark, tmp_path):
    feature = lambda i: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 2.5]}, "properties": {"i": i}}
    texts = {
        "one": json.dumps(feature(1)), "lines": "".join(json.dumps(feature(i)) + "\n" for i in (2, 3)), "records": "".join("\x1e" + json.dumps(feature(i)) + "\n" for i in (4, 5)),
        "many": json.dumps({"type": "FeatureCollection", "features": [feature(6), feature(7)]}, indent=1), "none": '{"type":"FeatureCollection","features":[]}', "bare": '{"type":"Point","coordinates":[8,2.5]}',
    }
    for n, t in texts.items():
        (tmp_path / f"{n}.geojson").write_text(t)
    got = convert.read_geojson(spark, str(tmp_path)).collect()
    assert sorted(struct.unpack("<d", bytes(r.geom)[5:13])[0] for r in got) == list(range(1, 9))
    assert sorted(json.loads(r.properties)["i"] for r in got if r.properties) == list(range(1, 8))
    (tmp_path / "bad.json").write_text('{"type":"Topology"}')
    with pytest.raises(Exception, match="no GeoJSON feature in .*bad.json"):
        convert.read_geojson(spark, str(tmp_path / "bad.json")).collect()


UTM_PRJ = 'PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",15.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
BASE = 'BASEGEOGCRS["WGS 84",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]]'
UTM_WKT2 = f'PROJCRS["UTM 33",{BASE},CONVERSION["c",METHOD["Transverse Mercator"],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",15,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996],PARAMETER["False easting",500,LENGTHUNIT["kilometre",1000]],PARAMETER["False northing",0]],CS[Cartesian,2],AXIS["(E)",east,ORDER[1]],AXIS["(N)",north,ORDER[2]],LENGTHUNIT["metre",1],ID["EPSG",32633]]'


def test_systems_are_compared_by_their_facts():
    from cartolith.functions import wkt

    assert wkt.problems(UTM_WKT2, 32633) == "" and wkt.problems(UTM_WKT2, 32634) == "code,parameters" and wkt.problems(UTM_PRJ, 32633) == ""
    assert wkt.problems(UTM_WKT2.replace("6378137", "6378388"), 32633) == "ellipsoid"
    assert wkt.problems(UTM_WKT2.replace('"Greenwich",0', '"Paris",2.33'), 32633) == "prime meridian"
    swapped = UTM_WKT2.replace('AXIS["(E)",east,ORDER[1]],AXIS["(N)",north,ORDER[2]]', 'AXIS["(N)",north],AXIS["(E)",east]')
    assert wkt.problems(swapped, 32633) == "axis order" and wkt.problems(swapped.replace("CS[Cartesian,2]", "CS[Cartesian,3]"), 32633) == "axes"
    assert wkt.problems(UTM_WKT2.replace("Transverse Mercator", "Mercator (variant A)"), 32633) == "method"
    assert wkt.problems(maker.GEOGRAPHIC, 4326) == "" and wkt.problems(UTM_WKT2[:-1], 32633) == "unreadable" and wkt.problems("undefined", 4326) is None and wkt.problems(UTM_WKT2, 2056) is None
    compound = 'COMPOUNDCRS["x",GEOGCRS["WGS 84",DATUM["World Geodetic System 1984"],CS[ellipsoidal,2],AXIS["a",north],AXIS["b",east]],VERTCRS["h",VDATUM["{}"],CS[vertical,1],AXIS["h",up]],ID["EPSG",9518]]'
    assert wkt.problems(compound.format("EGM2008 geoid"), 9518) == "" and wkt.problems(compound.format("EGM96 geoid"), 9518) == "vertical datum"
    for bad, why in (("", "no definition"), ("A[1]]", "text after the end"), ("A[", "nothing closes"), ('A["x"["y"]]', "without a keyword"), ("A[" * 70 + "]" * 70, "nested too deeply"), ("A[#]", "unreadable at 3"), ('"x"', "without a keyword")):
        with pytest.raises(ValueError, match=why):
            wkt.parse(bad)
    assert wkt.parse('A ["say ""x""", -1.5e3 , b]').values == ['say "x"', -1500.0, "b"]


def test_codes_are_found_by_facts(spark, tmp_path):
    from cartolith.functions import wkt

    assert wkt.identify(UTM_PRJ) == 32633 and wkt.identify(UTM_PRJ.replace("15.0", "-177.0").replace('"False_Northing",0.0', '"False_Northing",10000000.0')) == 32701
    assert wkt.identify('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]') == 4326
    assert wkt.identify('GEOGCS["x",DATUM["D_ETRS_1989",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0]]') is None and wkt.identify("junk") is None and wkt.identify(None) is None
    assert wkt.identify(UTM_WKT2.replace('32633]', '2056]')) == 2056 and wkt.identify(UTM_WKT2.replace('32633]', '32634]')) is None
    got = spark.createDataFrame([(UTM_PRJ, 32633), (None, None)], "w string, s int").select(wkt.code_of(F.col("w")).alias("c"), wkt.structure_problems(F.col("w"), F.col("s")).alias("p")).collect()
    assert [(r.c, r.p) for r in got] == [(32633, ""), (None, None)]
    for n in ("a", "b"):
        (tmp_path / f"{n}.shp").write_bytes(b"")
    assert shapefile.system_of(str(tmp_path)) is None
    (tmp_path / "a.prj").write_text(UTM_PRJ)
    assert shapefile.system_of(str(tmp_path)) == 32633
    (tmp_path / "b.prj").write_text(UTM_PRJ.replace("15.0", "21.0"))
    with pytest.raises(ValueError, match="several systems"):
        shapefile.system_of(str(tmp_path))


def test_rollup_from_files(spark, wells, odd, tmp_path, capsys):
    import csv

    from cartolith.__main__ import main

    out = str(tmp_path / "r")
    main(["validate", wells, "--rollup", out, "--as-of", AS_OF])
    main(["validate", odd, "--rollup", out, "--batch", "1", "--as-of", AS_OF])
    main(["validate", odd, "--rollup", out, "--batch", "1", "--as-of", AS_OF])
    table = {int(r["Req"]): r for r in csv.DictReader(next((tmp_path / "r/rollup").glob("*.csv")).read_text().splitlines())}
    assert len(table) == 37 and table[13]["Applicable GPKGs"] == "6" and table[1]["Applicable GPKGs"] == "0"
    facts = spark.read.parquet(f"{out}/facts")
    status = {(os.path.basename(r.file), r.req): r for r in facts.collect()}
    assert len(status) == 6 * 37
    for req, r in table.items():
        own = [x for (_, q), x in status.items() if q == req and x.status != "SKIPPED"]
        assert (int(r["Applicable GPKGs"]), int(r["Validator Disputes"])) == (len(own), sum(x.status in ("FAIL", "ERROR") for x in own))
        assert int(r["PASS* Count"]) == sum(x.status == "PASS*" for x in own) and int(r["PASS* Manual Confirmed"]) == sum(x.status == "PASS*" and x.total_n > 0 and x.confirmed == x.total_n for x in own)
        assert int(r["Auditor Disputes"]) == sum(x.status in ("FAIL", "PASS*") and req in (3, 5, 11, 12, 14, 22, 24, 25, 32) for x in own)
    assert (status["a.gpkg", 9].confirmed, status["a.gpkg", 9].total_n) == (2, 2) and status["a.gpkg", 9].software == "UNKNOWN"
    files = [json.loads(x) for f in (tmp_path / "r/files").glob("*.json") for x in f.read_text().splitlines()]
    assert len(files) == 4 and {a["audit"] for f in files for a in f["audits"]} >= {"extensions", "documents"} and all(len(f["requirements"]) == 37 and "software" in f for f in files)
    main(["layers", wells])
    assert "a.gpkg: wells (features, POINT, system EPSG:4326, 4 rows): fid, geom, remark" in capsys.readouterr().out


def test_files_are_finalised_in_place(spark, tmp_path, capsys):
    from cartolith.__main__ import main
    from cartolith.plans.finalise import finalise

    d = tmp_path / "f"
    d.mkdir()
    raised = struct.pack("<BI3d", 1, 1001, 12.0, 50.0, 7.0)
    spoiled = [
        "PRAGMA user_version = 10100", "PRAGMA application_id = 0", "ALTER TABLE gpkg_spatial_ref_sys DROP COLUMN definition_12_063", "DELETE FROM gpkg_extensions WHERE extension_name = 'gpkg_crs_wkt'",
        ("INSERT INTO gpkg_spatial_ref_sys (srs_name, srs_id, organization, organization_coordsys_id, definition, description) VALUES ('x', 2056, 'EPSG', 2056, ?, '')", (maker.MERCATOR,)), "UPDATE gpkg_contents SET max_x = 11 WHERE table_name = 'wells'",
        ("UPDATE wells SET geom = ? WHERE fid = 3", (maker.blob(raised),)), "CREATE TRIGGER t AFTER UPDATE ON wells BEGIN INSERT OR REPLACE INTO rtree_wells_geom VALUES (NEW.fid, ST_MinX(NEW.geom), ST_MaxX(NEW.geom), ST_MinY(NEW.geom), ST_MaxY(NEW.geom)); END",
    ]
    maker.make(d / "old.gpkg", "survey", *spoiled)
    maker.make(d / "wal.gpkg", "survey", *spoiled[3:5])
    con = sqlite3.connect(d / "wal.gpkg")
    con.execute("PRAGMA journal_mode = WAL")
    con.execute("INSERT INTO wells (geom, remark) VALUES (?, 'late')", (maker.blob(maker.point(15, 50)),))
    con.execute("INSERT INTO rtree_wells_geom VALUES (5, 15, 15, 50, 50)")
    con.commit()
    maker.make(d / "stuck.gpkg", "survey", "DROP TABLE gpkg_extensions", "CREATE VIEW gpkg_extensions AS SELECT 1 AS extension_name", "PRAGMA user_version = 10100")
    before = (d / "stuck.gpkg").read_bytes()
    assert main(["finalise", str(d)]) == 1
    con.close()
    said = capsys.readouterr().out
    assert "stuck.gpkg: not changed" in said and (d / "stuck.gpkg").read_bytes() == before and all(not x.startswith(".") for x in os.listdir(d))
    again = {os.path.basename(r["file"]): r for r in finalise(spark, str(d))}
    assert again["old.gpkg"]["changes"] == [] == again["wal.gpkg"]["changes"] and again["stuck.gpkg"]["error"]
    assert (d / "old.gpkg").read_bytes()[18:20] == b"\1\1" and gpkg.read_layer(spark, str(d / "wal.gpkg"), "wells").count() == 5
    os.unlink(d / "stuck.gpkg")
    facts = findings(gpkg.read_catalog(spark, str(d)).written(str(tmp_path / "c")), AS_OF)
    status = {(os.path.basename(r.file), r.req): r for r in facts.collect()}
    for f in ("old.gpkg", "wal.gpkg"):
        assert all(status[f, q].status in ("PASS", "PASS*") for q in (3, 13, 24)), [status[f, q] for q in (3, 13, 24)]
    con = sqlite3.connect(d / "old.gpkg")
    assert con.execute("SELECT hex(geom) FROM wells WHERE fid = 3").fetchone()[0].endswith(maker.point(12, 50).hex().upper())
    assert con.execute("SELECT srs_id FROM gpkg_spatial_ref_sys ORDER BY 1").fetchall() == [(-1,), (0,), (4326,)] and con.execute("PRAGMA user_version").fetchone() == (10400,)
    con.close()


def test_content_models_name_what_is_wrong(spark):
    from cartolith.functions import schema

    party = lambda *c: "<contact><CI_ResponsibleParty>" + "".join(f"<{x}/>" for x in c) + "</CI_ResponsibleParty></contact>"
    whole = "<MD_Metadata><fileIdentifier/><language/><language/>{}<dateStamp/><identificationInfo/></MD_Metadata>"
    cases = {
        whole.format(party("organisationName", "role")): [],
        whole.format(party("role", "organisationName", "role", "hat")): ["CI_ResponsibleParty: order organisationName", "CI_ResponsibleParty: repeated role", "CI_ResponsibleParty: unknown hat"],
        "<MD_Metadata><language/><fileIdentifier/><dateStamp/><dateStamp/><moon/></MD_Metadata>": ["MD_Metadata: order fileIdentifier", "MD_Metadata: repeated dateStamp", "MD_Metadata: unknown moon", "MD_Metadata: missing contact", "MD_Metadata: missing identificationInfo"],
        "<!-- x --><Other><MD_Metadata/></Other>": ["Other: no such root", *[f"MD_Metadata: missing {n}" for n in ("fileIdentifier", "language", "contact", "dateStamp", "identificationInfo")]],
        "<MD_Metadata>": None, "": None, None: None,
    }
    got = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", schema.content_problems(schema.sequences(F.col("x"))).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == list(cases.values())


def geotiff(order="<", big=False, code=32633, width=700, height=400):
    """A TIFF's header and directory, with values that lie behind it, and no pixels."""
    entries = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (8, 8, 8)), (259, 3, (5,)), (277, 3, (3,)), (322, 3, (256,)), (33550, 12, (10.0, 20.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 500000.0, 5000000.0, 0.0)),
               (34735, 3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072 if code > 5000 else 2048, 0, 1, code)), (42113, 2, b"-9999\0")]
    letters, sizes = {3: "H", 4: "I", 12: "d"}, {2: 1, 3: 2, 4: 4, 12: 8}
    inline, head = (8, 16) if big else (4, 8)
    directory, behind = b"", b""
    start = head + (8 if big else 2) + len(entries) * (20 if big else 12)
    for tag, kind, values in entries:
        data = values if kind == 2 else struct.pack(order + letters[kind] * len(values), *values)
        directory += struct.pack(order + "HH" + ("Q" if big else "I"), tag, kind, len(values))
        if len(data) <= inline:
            directory += data.ljust(inline, b"\0")
        else:
            directory += struct.pack(order + ("Q" if big else "I"), start + len(behind))
            behind += data
        assert len(data) == sizes[kind] * len(values)
    mark = b"II" if order == "<" else b"MM"
    first = mark + (struct.pack(order + "HHHQQ", 43, 8, 0, 16, len(entries)) if big else struct.pack(order + "HIH", 42, 8, len(entries)))
    return first + directory + behind


def test_rasters_are_scanned_by_their_headers(spark, tmp_path):
    from cartolith.sources.raster import scan_rasters

    for n, data in (("a.tif", geotiff()), ("b.tif", geotiff(">", True)), ("c.tiff", geotiff(code=4326)), ("d.png", maker.png(300, 20)), ("e.jpg", maker.jpeg(64, 32, before=90000)), ("cut.tif", geotiff()[:150]), ("junk.tif", b"II*"), ("other.txt", b"x"), ("f.tif", geotiff(code=32767))):
        (tmp_path / n).write_bytes(data)
    got = {os.path.basename(r.file): r for r in scan_rasters(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.tif", "b.tif", "c.tiff", "d.png", "e.jpg", "cut.tif", "junk.tif", "f.tif"}
    for n, code in (("a.tif", 32633), ("b.tif", 32633), ("c.tiff", 4326), ("f.tif", None)):
        r = got[n]
        assert (r.format, r.width, r.height, r.bands, r.bits, r.tiled, r.compression, r.srs_id) == ("TIFF", 700, 400, 3, 8, True, 5, code)
        assert (r.origin_x, r.origin_y, r.pixel_x, r.pixel_y, r.nodata, r.error) == (500000.0, 5000000.0, 10.0, 20.0, "-9999", None)
    assert (got["d.png"].width, got["d.png"].height, got["e.jpg"].width, got["e.jpg"].height) == (300, 20, 64, 32)
    assert "beyond its end" in got["cut.tif"].error and got["junk.tif"].error == "no TIFF"
    assert scan_rasters(spark, str(tmp_path / "nothing*")).collect() == []
