"""Projections, geometry, headers, conversion and streams by themselves."""

import json
import math
import random
import struct

import numpy as np
import pytest
from maker import blob, jpeg, line, many, png, point, polygon, tiff
from pyspark.sql import functions as F

from cartolith import dims
from cartolith.functions import binary, crs, geometry, text, transform, xml
from cartolith.operators import maintenance, scoring, zoom
from cartolith.plans import convert
from cartolith.streaming import arrivals


def test_projections_at_known_points(spark):
    points = spark.createDataFrame([(1, 3.0, 52.0), (2, 9.0, 0.0), (3, -100.0, 40.0), (4, 44.0, 73.0)], "k int, lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    cols = [*crs.mercator(lon, lat), *crs.world_mercator(lon, lat), *crs.utm(lon, lat, crs.utm_zone(lon), lat < 0), *crs.ups(lon, lat, lat < 0)]
    got = {r[0]: r[1:] for r in points.select("k", *cols).collect()}
    assert got[2][4] == pytest.approx(500000, abs=1e-3) and got[2][5] == pytest.approx(0, abs=1e-3)
    assert got[3][0] == pytest.approx(-11131949.079, abs=1e-2) and got[3][1] == pytest.approx(4865942.279, abs=1e-2)
    # Published example for polar stereographic north: 73 N, 44 E.
    assert got[4][6:] == pytest.approx((3320416.75, 632668.43), abs=0.01)
    assert got[1][4] == pytest.approx(500000, abs=1e-3)
    back = points.select("k", *crs.mercator_inverse(*crs.mercator(lon, lat))).collect()
    assert all(r[1] == pytest.approx(x, abs=1e-9) and r[2] == pytest.approx(y, abs=1e-9) for r, (x, y) in zip(back, [(3, 52), (9, 0), (-100, 40), (44, 73)]))
    with pytest.raises(ValueError):
        crs.project(lon, lat, 27700)


def test_validity_agrees_with_the_jvm_library(spark):
    """JTS comes with Spark; on random small polygons both call the same ones valid."""
    jvm, r = spark._jvm, random.Random(1)
    reader = jvm.org.locationtech.jts.io.WKBReader()
    blobs = []
    for _ in range(300):
        n = r.randrange(3, 7)
        ring = [(r.randrange(0, 6), r.randrange(0, 6)) for _ in range(n)]
        blobs.append(polygon(*ring, ring[0]))
    # Rectangles with holes, and members, in all positions to each other.
    box = lambda x, y, w, h: ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
    some = lambda k: box(r.randrange(0, 5), r.randrange(0, 5), r.randrange(1, k), r.randrange(1, k))
    for _ in range(250):
        blobs.append(polygon(box(0, 0, 8, 8), *[some(4) for _ in range(r.randrange(1, 3))]))
        blobs.append(many(6, *[polygon(some(5), *([some(3)] if r.random() < 0.3 else [])) for _ in range(r.randrange(1, 4))]))
    together = geometry.problems(blobs)
    for data, found in zip(blobs, together):
        check = jvm.org.locationtech.jts.operation.valid.IsValidOp(reader.read(bytearray(data)))
        assert found == geometry.problem(data)
        if not check.isValid() and "disconnected" in check.getValidationError().toString():
            continue  # not looked for
        assert (found is None) == check.isValid(), (found, str(check.getValidationError()), geometry.parse(data))


def test_holes_and_unreadable_geometry():
    ring = lambda *p: struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", *q) for q in p)
    shell, hole, far = ring((0, 0), (9, 0), (9, 9), (0, 9), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 1)), ring((20, 20), (21, 20), (21, 21), (20, 20))
    two = lambda a, b: struct.pack("<BII", 1, 3, 2) + a + b
    assert geometry.problem(two(shell, hole)) is None and geometry.problem(two(shell, far)) == "hole outside shell"
    assert geometry.problem(b"\x01\x03") == "not readable" and geometry.problem(None) is None
    square = lambda x, y, s: ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))
    assert geometry.problem(polygon(square(0, 0, 10), square(1, 1, 8), square(2, 2, 2))) == "nested holes"
    assert geometry.problem(many(6, polygon(square(0, 0, 10), square(1, 1, 8)), polygon(square(2, 2, 2)))) is None
    assert geometry.problem(many(6, polygon(square(0, 0, 10)), polygon(square(2, 2, 2)))) == "members overlap"
    assert geometry.problem(many(7, point(1, 1), polygon((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)))) == "self-intersection"
    assert geometry.problem(many(5, line((0, 0), (1, 1)), line((2, 2), (2, 2)))) == "too few points"
    assert geometry.problem(polygon((0, 0), (1, 0), (float("nan"), 1), (0, 0))) == "bad coordinate"
    z = struct.pack("<BI3d", 1, 1001, 1, 2, 3)
    assert geometry.flatten(z) == struct.pack("<BI2d", 1, 1, 1, 2) and geometry.flatten(None) is None
    collection = struct.pack("<BII", 1, 1004, 2) + z + z
    assert geometry.parse(geometry.flatten(collection))[0] == 4


def test_headers_in_both_modes(spark):
    blobs = [(code, struct.pack("<2sBBi", b"GP", 0, 1 | code << 1, 4326) + b"\0" * binary.ENVELOPE_BYTES[code] + struct.pack("<BI2d", 1, 1001, 0, 0)) for code in range(5)]
    df = spark.createDataFrame(blobs, "code int, b binary")
    got = {r.code: r for r in df.select("code", binary.gp_header(F.col("b")).alias("c"), binary.gp_header(F.col("b"), compat=False).alias("s")).collect()}
    assert [(got[k].c.has_z, got[k].c.has_m) for k in range(5)] == [(False, False), (True, False), (False, True), (True, True), (False, False)]
    assert all(r.s.has_z and not r.s.has_m and r.c.wkb_type == 1001 and r.c.srs_id == 4326 for r in got.values())
    images = spark.createDataFrame([(png(300),), (b"RIFF\x00\x00\x00\x00WEBP",), (b"",), (None,)], "b binary").select(binary.image_format(F.col("b")).alias("f"), binary.png_size(F.col("b")).alias("s")).collect()
    assert images[0].s.width == 300 and [r.f for r in images[:3]] == ["PNG", "WEBP", "UNKNOWN"]
    assert [binary.image_head(x) for x in (png(300, 7), jpeg(12, 34, before=70000), tiff(99), tiff(98, ">"), b"RIFF\0\0\0\0WEBP", b"?", None)] == [
        ("PNG", (300, 7)), ("JPEG", (12, 34)), ("TIFF", (99, 99)), ("TIFF", (98, 98)), ("WEBP", None), ("UNKNOWN", None), ("UNKNOWN", None)]
    assert binary.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + b"\0" * 9) == (32, 16) and binary.jpeg_size(b"no") is None


def test_documents_are_well_formed_and_complete(spark):
    df = spark.range(1).select(xml.metadata_document(F.lit("a<b>&"), F.lit("t"), F.lit(None).cast("string"), F.lit("eng"), F.lit("2025-01-01T00:00:00Z")).alias("x"))
    r = df.select(xml.well_formed(F.col("x")).alias("ok"), text.elements_present(F.col("x")).alias("n"), text.scope_code(F.col("x")).alias("s")).first()
    assert r.ok and r.n == 7 and r.s == "dataset"


@pytest.mark.parametrize("counts,verdict", [((0, 0, 0, 0), "CONFORMANT"), ((0, 0, 0, 2), "AUTOMATED CHECKS CONFORMANT"), ((0, 0, 1, 2), "LIKELY CONFORMANT"), ((3, 0, 1, 0), "NON-CONFORMANT"), ((3, 1, 0, 0), "VALIDATION ERROR")])
def test_verdict_ladder(spark, counts, verdict):
    assert spark.range(1).select(scoring.verdict(*map(F.lit, counts))).first()[0] == verdict


def test_sample_with_empty_buckets(spark):
    keys = [0, 1, 2, 90, 95, 100]
    got = maintenance.stratified_sample(spark.createDataFrame([("a", k) for k in keys], "g string, fid long"), 5, by=["g"])
    want = {min(k for k in keys if k >= t) for t in range(0, 100, 20)}
    assert {r.fid for r in got.collect()} == want


def test_overview_levels(spark):
    for side in (1, 256, 257, 512, 513, 5000, 10**6):
        want, f = [], 2
        while side // f > 256 and len(want) < 8:
            want.append(f)
            f *= 2
        assert spark.range(1).select(zoom.overview_levels(F.lit(side), F.lit(1))).first()[0] == (want or [2])


def test_convert_geojson(spark, tmp_path):
    shapes = [{"type": "Point", "coordinates": [1, 2, 3]}, {"type": "Point", "coordinates": [4, 5]}, None]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"name": f"<{i}>"}} for i, g in enumerate(shapes)]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    df = convert.read_geojson(spark, str(tmp_path / "a.geojson")).select("geom", F.get_json_object("properties", "$.name").alias("name"), F.unhex(F.lit("00")).alias("raw"))
    out = convert.convert_layer(df, str(tmp_path / "out"), layer="places", title="Places", abstract="All the places", stamp="2025-01-01T00:00:00Z")
    assert out == {"layer": "places", "features": 3, "geometries": 2, "lost": 0, "dropped_columns": ["raw"], "srs_id": 4326}
    assert convert.layer_type(df) == "POINT"
    assert convert.input_warnings(3857, "vector_2d") and not convert.input_warnings(4326, "vector_2d")
    p = convert.reproject_points(spark.createDataFrame([(-11131949.079327356 / dims.WGS84_A * 180 / math.pi, 40.0)], "lon double, lat double"), "lon", "lat", 3857).first()
    assert p.x == pytest.approx(-11131949.079327356)


def test_windowed_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = arrivals.windowed_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_arriving_files_are_validated(spark, tmp_path):
    from maker import make

    from cartolith.sources import gpkg

    (tmp_path / "in").mkdir()
    make(tmp_path / "in" / "a.gpkg", "imagery")
    gpkg.register(spark)
    got = []
    arrivals.validate_arrivals(spark, str(tmp_path / "in"), lambda facts, i: got.append(facts.filter("status = 'FAIL'").count()), "2026-12-31T00:00:00Z", str(tmp_path / "c")).awaitTermination()
    assert got == [0]


def write_shapefile(path, kind, records, names):
    """Records as shape bytes; one text attribute ``name`` of 10 and one number ``k`` of 5."""
    body = b"".join(struct.pack(">ii", i, len(r) // 2) + r for i, r in enumerate(records, 1))
    head = struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii", 1000, kind) + b"\0" * 64
    path.write_bytes(head + body)
    fields = b"".join(n.encode().ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, t, w in (("name", b"C", 10), ("k", b"N", 5)))
    rows = b"".join(b" " + n.encode("utf-8").ljust(10) + str(i).rjust(5).encode() for i, n in enumerate(names))
    path.with_suffix(".dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(names), 32 + len(fields) + 1, 16) + fields + b"\r" + rows)


def test_shapefiles(spark, tmp_path):
    from cartolith.sources import shapefile

    point = lambda x, y: struct.pack("<i2d", 1, x, y)
    write_shapefile(tmp_path / "p.shp", 1, [point(1, 2), struct.pack("<i", 0), point(3, 4)], ["a", "b", "ç"])
    shapefile.register(spark)
    df = spark.read.format("shp").load(str(tmp_path / "p.shp"))
    assert df.columns == ["file", "geom", "name", "k"]
    got = [(r.geom and struct.unpack("<BI2d", r.geom), r["name"], r.k) for r in df.collect()]
    assert got == [((1, 1, 1.0, 2.0), "a", 0), (None, "b", 1), ((1, 1, 3.0, 4.0), "ç", 2)]
    shell, hole, other = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 0), (20, 1), (21, 1), (20, 0)]
    rings = [shell, hole, other]
    starts = [0, 5, 9]
    data = struct.pack("<i4dii3i", 5, 0, 0, 21, 9, 3, 13, *starts) + b"".join(struct.pack("<2d", *p) for r in rings for p in r)
    kind, _, members, _ = geometry.parse(shapefile.shape_wkb(data))
    assert kind == 6 and [len(m[2]) for m in members] == [2, 1] and geometry.problem(shapefile.shape_wkb(data)) is None


def test_second_layer_keeps_the_first_and_bad_rows_fail(spark, tmp_path):
    from cartolith.sources import gpkg

    path, point = str(tmp_path / "two"), struct.pack("<BI2d", 1, 1, 1.0, 2.0)
    gpkg.register(spark)
    rows = spark.createDataFrame([(bytearray(point), i) for i in range(6)], "geom binary, n long").repartition(2)
    for layer in ("a", "b"):
        rows.write.format("gpkg").mode("append").options(path=path, layer=layer).save()
    rows.write.format("gpkg").mode("append").options(path=path, layer="b").save()
    got = {r.table_name: r["count"] for r in gpkg.read_table(spark, path, "__features__").groupBy("table_name").count().collect()}
    assert got == {"a": 6, "b": 12}
    bad = spark.createDataFrame([(bytearray(point), 1), (bytearray(b"\x01\x01"), 2)], "geom binary, n long").coalesce(1)
    with pytest.raises(Exception, match="1 rows cannot be written"):
        bad.write.format("gpkg").mode("append").options(path=path, layer="c").save()
    assert gpkg.read_table(spark, path, "__features__").count() == 18
    bad.write.format("gpkg").mode("append").options(path=path, layer="c", skip_invalid="true").save()
    assert gpkg.read_table(spark, path, "__features__").count() == 19


def test_large_rings_need_little_memory():
    import tracemalloc

    import numpy as np

    a = np.linspace(0, 2 * np.pi, 50001)
    far = 1000 + np.random.default_rng(0).random(50001) * 3
    p = np.stack([far * np.cos(a), far * np.sin(a)], 1)
    p[-1] = p[0]
    data = struct.pack("<BIII", 1, 3, 1, len(p)) + p.astype("<f8").tobytes()
    tracemalloc.start()
    assert geometry.problem(data) is None
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    p[[100, 25000]] = p[[25000, 100]]
    assert geometry.problem(data[:13] + p.astype("<f8").tobytes()) == "self-intersection"


def test_transforms_there_and_back(spark):
    import numpy as np

    r = np.random.default_rng(1)
    lon, lat = r.uniform(-179, 179, 500), r.uniform(-79, 83, 500)
    for code in (3857, 3395, 5041, 5042, 32633, 32733):
        x, y = (lon, lat) if code < 32000 else (15 + r.uniform(-3, 3, 500), lat)
        y = np.abs(y) if code in (5041,) else -np.abs(y) if code == 5042 else y
        back = transform.to_degrees(*transform.from_degrees(x, y, code), code)
        assert np.allclose(back[0], x, atol=1e-9) and np.allclose(back[1], y, atol=1e-9), code
    # The same as the column expressions.
    points = spark.createDataFrame([(15.5, 47.25), (9.0, -33.0)], "lon double, lat double")
    for code in (3857, 3395, 5041, 5042, 32633, 32733):
        for r_ in points.select("lon", "lat", *crs.project(F.col("lon"), F.col("lat"), code)).collect():
            assert transform.from_degrees(np.array([r_[0]]), np.array([r_[1]]), code) == pytest.approx(r_[2:], abs=1e-4)
    with pytest.raises(ValueError):
        transform.reproject(F.col("geom"), 27700, 4326)
    shape = many(7, point(1.0, 2.0), line((3.0, 4.0), (5.0, 6.0)), polygon((0, 0), (1, 0), (1, 1), (0, 0)))
    there = transform.transform(shape, 4326, 3857)
    assert there != shape and geometry.parse(transform.transform(there, 3857, 4326))[2][1][2] == pytest.approx(np.array([[3.0, 4.0], [5.0, 6.0]]))
    df = spark.createDataFrame([(bytearray(shape),), (bytearray(b"?"),), (None,)], "geom binary")
    assert [r[0] is None for r in df.select(transform.reproject(F.col("geom"), 4326, 3395)).collect()] == [False, True, True]


def test_layer_types_modes_and_profiles(spark):
    z = struct.pack("<BI3d", 1, 1001, 1, 2, 3)
    big = struct.pack(">BI2d", 0, 1, 1, 2)
    df = lambda *blobs: spark.createDataFrame([(None if b is None else bytearray(b),) for b in blobs], "geom binary")
    assert convert.layer_type(df(z, None, point(1, 2), big)) == "POINT"
    # The only other type stands far behind the first rows.
    assert convert.layer_type(df(*[point(0, 0)] * 700, line((0, 0), (1, 1)))) == "GEOMETRY" and convert.layer_type(df(None)) == "GEOMETRY"
    assert [convert.target_system(s, m, 3395) for s, m in ((3857, "a"), (27700, "a"), (None, "a"), (4326, "b"), (27700, "keep"))] == [3857, 4326, 4326, 3395, 27700]
    assert convert.with_profile("military", language="fra", topic=None) == {"security": "CONFIDENTIAL", "language": "fra", "topic": "intelligenceMilitary"}
    with pytest.raises(ValueError):
        convert.with_profile("naval")
    names = spark.createDataFrame([("o'brien_road2a",), ("wells",)], "n string").select(convert._title(F.col("n"))).collect()
    assert [r[0] for r in names] == [n.replace("_", " ").title() for n in ("o'brien_road2a", "wells")]


def test_layers_with_broken_shapes_are_reprojected(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(point(-11131949.079327356, 4865942.279503176)), "a", 1), (bytearray(b"\x01\x03\0"), "b", 2), (None, "c", 3)], "geom binary, name string, n long")
    out = convert.convert_layer(rows, str(tmp_path / "o"), layer="l", title="Places", abstract="All of the places", stamp="2025-01-01T00:00:00Z", srs_id=3857, mode="b")
    assert (out["features"], out["geometries"], out["lost"], out["srs_id"]) == (3, 1, 1, 4326)
    from cartolith.sources import gpkg

    blobs = [bytes(r.geom) for r in gpkg.read_table(spark, str(tmp_path / "o"), "__features__").filter("geom IS NOT NULL").collect()]
    assert struct.unpack("<2d", blobs[0][-16:]) == pytest.approx((-100, 40), abs=1e-9) and len(blobs) == 1


def test_what_a_path_holds(tmp_path):
    from maker import make

    from cartolith.sources import detect

    make(tmp_path / "a.gpkg", "survey")
    for name, data in (("b.shp", b"\x00\x00\x27\x0a" + b"\0" * 96), ("c.json", b'\n {"type": 1}'), ("d.tif", tiff(4)), ("e.bin", b"?"), ("f.jpg", jpeg(1))):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "wrap" / "x.gdb").mkdir(parents=True)
    got = {p.name: detect.kind_of(str(p)) for p in tmp_path.iterdir()}
    assert {k: v for k, v in got.items() if k not in ("wrap", "e.bin")} == {"a.gpkg": ("vector", "gpkg"), "b.shp": ("vector", "shp"), "c.json": ("vector", "geojson"), "d.tif": ("raster", "tiff"), "f.jpg": ("raster", "jpeg")}
    assert got["wrap"][0] == got["e.bin"][0] == "none" and detect.resolve(str(tmp_path / "wrap")).endswith("x.gdb") and detect.kind_of("/no/such")[1] == "no such path"
    assert detect.input_formats() == ["geojson", "gpkg", "shp"]
    assert detect.output_problem(str(tmp_path / "new")) is None and detect.output_problem(str(tmp_path / "e.bin")) and detect.output_problem("/no/such/folder")
    assert convert.summary([{"features": 3, "lost": 1}, {"features": 5, "lost": 0}], 2.0)["features_per_second"] == 4


def test_document_facts():
    from maker import document

    f = xml.document_facts(document())
    assert f["ok"] and f["children"][0] == "fileIdentifier" and f["n_mandatory"] == 7 and (f["language"], f["charset"], f["scope"], f["organisation"], f["role"], f["stamp"]) == ("eng", "utf8", "dataset", "Survey office", "owner", "2024-05-06")
    for bad in (None, "", "  ", "<a>", "no"):
        assert xml.document_facts(bad)["ok"] is False and xml.document_facts(bad)["n_mandatory"] == 0
    assert xml.document_facts("<a><!-- remark --><?x y?><b/></a>")["ok"]
    assert blob(b"", (1, 2, 3, 4))[8:40] == struct.pack("<4d", 1, 3, 2, 4)


def square(x, y, w, h=None):
    return np.array([(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w)), (x, y)], float)


def test_interiors_in_pieces_against_flood_fill():
    """Holes of whole cells that meet in corners only: the interior is in one piece if its cells are."""
    import random

    from cartolith.functions.geometry import polygon_problem

    r, seen = random.Random(3), {None: 0, "interior in pieces": 0}
    for _ in range(400):
        n, used, holes = 6, np.zeros((8, 8), bool), []
        used[0], used[-1], used[:, 0], used[:, -1] = True, True, True, True
        outside = used.copy()
        for _ in range(60):
            x, y, w, h = r.randrange(1, n + 1), r.randrange(1, n + 1), r.choice((1, 1, 1, 2)), r.choice((1, 1, 1, 2))
            cells = [(i, j) for i in range(x, x + w) for j in range(y, y + h)]
            if x + w > n or y + h > n or any(used[i + a, j + b] for i, j in cells for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))):
                continue
            for i, j in cells:
                used[i, j] = True
            holes.append(square(x, y, w, h))
        free = {(i, j) for i in range(1, n + 1) for j in range(1, n + 1) if not used[i, j]} if holes else set()
        todo = [next(iter(free))] if free else []
        reached = set(todo)
        while todo:
            i, j = todo.pop()
            new = {(i + a, j + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))} & free - reached
            reached |= new
            todo += new
        want = None if reached == free else "interior in pieces"
        assert polygon_problem([square(1, 1, n), *holes]) == want, holes
        seen[want] += 1
    assert seen["interior in pieces"] > 10 and seen[None] > 10 and outside.any()


def test_many_holes_take_one_sweep():
    import time

    from cartolith.functions.geometry import polygon_problem

    a = np.linspace(0, 2 * np.pi, 20001)
    shell = np.column_stack([np.cos(a), np.sin(a)]) * 200
    shell[-1] = shell[0]
    holes = [square(-100 + 2 * (i % 100), -100 + 2 * (i // 100), 1) for i in range(10000)]
    t = time.perf_counter()
    assert polygon_problem([shell, *holes]) is None
    assert time.perf_counter() - t < 20
    assert polygon_problem([shell, *holes, square(-99.7, -99.7, 0.2)]) == "nested holes"
    assert polygon_problem([shell, *holes, square(300, 0, 1)]) == "hole outside shell" and polygon_problem([shell, *holes, square(-99.5, -99.5, 1)]) == "rings cross"
    assert polygon_problem([square(0, 0, 9), np.array([(0, 3), (3, 2), (3, 4), (0, 3)], float)]) is None
    assert polygon_problem([square(0, 0, 9), np.array([(0, 3), (9, 2), (3, 4), (0, 3)], float)]) == "interior in pieces"
