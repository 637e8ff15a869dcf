"""Files in, verdicts out: the source, the requirements over it, and the writer."""

import json

import maker
import pytest
from pyspark.sql import functions as F

from cartolith.operators import requirements, scoring
from cartolith.plans.validate import examples, findings, whole_profile
from cartolith.sources import gpkg

AS_OF = "2026-12-31T00:00:00Z"
META = "UPDATE gpkg_metadata SET metadata = ? WHERE id = 7"
#: Name, kind, what is spoiled, and the requirements whose status differs from the sound file's.
SOLID = maker.GEOGRAPHIC.replace("ellipsoidal,2", "ellipsoidal,3").replace("EAST]", 'EAST],AXIS["Up",UP]').replace("4326", "4979")
SPOILED = [
    ("scope", "survey", ["UPDATE gpkg_extensions SET scope = 'maybe' WHERE table_name = 'wells'"], {3: "FAIL"}),
    ("version", "survey", ["PRAGMA user_version = 10100"], {3: "FAIL"}),
    ("unregistered", "survey", ["DELETE FROM gpkg_extensions WHERE extension_name = 'gpkg_rtree_index'"], {3: "FAIL"}),
    ("changed", "survey", ["UPDATE gpkg_contents SET last_change = 'last week' WHERE table_name = 'wells'"], {3: "FAIL"}),
    ("optional", "survey", ["INSERT INTO gpkg_extensions VALUES ('wells', NULL, 'gpkg_schema', '-', 'read-write')"], {4: "PASS*"}),
    ("curves", "survey", ["INSERT INTO gpkg_extensions VALUES ('wells', 'geom', 'gpkg_geom_CURVE', '-', 'read-write')"], {5: "FAIL"}),
    ("flat", "survey", ["UPDATE gpkg_geometry_columns SET srs_id = 3395 WHERE table_name = 'wells'"], {9: "FAIL"}),
    ("solid", "survey", ["UPDATE gpkg_geometry_columns SET z = 2 WHERE table_name = 'wells'"], {10: "FAIL"}),
    ("first axis", "survey", [("UPDATE gpkg_spatial_ref_sys SET definition_12_063 = ? WHERE srs_id = 4326", (maker.GEOGRAPHIC.replace('AXIS["Lat",NORTH],AXIS["Lon",EAST]', 'AXIS["Lon",EAST],AXIS["Lat",NORTH]'),))], {13: "FAIL"}),
    ("datum", "survey", [("UPDATE gpkg_spatial_ref_sys SET definition_12_063 = ? WHERE srs_id = 4326", (maker.GEOGRAPHIC.replace("World Geodetic System 1984 ensemble", "Somewhere 1927"),))], {13: "FAIL"}),
    ("ellipsoid", "survey", [("UPDATE gpkg_spatial_ref_sys SET definition_12_063 = ? WHERE srs_id = 4326", (maker.GEOGRAPHIC.replace('(G2139)"]]', '(G2139)"],ELLIPSOID["Bessel 1841",6377397.155,299.1528128]]'),))], {13: "FAIL"}),
    ("third axis", "survey", [("UPDATE gpkg_spatial_ref_sys SET definition_12_063 = ? WHERE srs_id = 4326", (maker.GEOGRAPHIC.replace("ellipsoidal,2", "ellipsoidal,3").replace("EAST]", 'EAST],AXIS["Up",UP]'),))], {13: "FAIL"}),
    ("method", "imagery", [("UPDATE gpkg_spatial_ref_sys SET definition_12_063 = ? WHERE srs_id = 3395", (maker.MERCATOR.replace(',ID["EPSG"', ',CONVERSION["c",METHOD["Transverse Mercator"]],ID["EPSG"'),))], {13: "FAIL"}),
    ("foreign system", "survey", [("INSERT INTO gpkg_spatial_ref_sys VALUES ('x', 2056, 'EPSG', 2056, ?, '-', ?, NULL)", (maker.MERCATOR,) * 2)], {13: "FAIL"}),
    ("dynamic system", "survey", [("INSERT INTO gpkg_spatial_ref_sys VALUES ('x', 100250, 'EPSG', 100250, ?, '-', ?, NULL)", (maker.GEOGRAPHIC,) * 2)], {}),
    ("language", "survey", [(META, (maker.document(language="<gco:CharacterString>English</gco:CharacterString>"),))], {18: "FAIL"}),
    ("no contact", "survey", [(META, (maker.document(contact=None),))], {18: "FAIL"}),
    ("strange child", "survey", [(META, (maker.document(weather="fine"),))], {18: "FAIL"}),
    ("scope code", "survey", [(META, (maker.document("landscape"),))], {18: "FAIL"}),
    ("later standard", "survey", [(META, (maker.document().replace("http://www.isotc211.org/2005/gmd", "http://standards.iso.org/iso/19115/-3/mdb/2.0"),))], {18: "PASS*"}),
    ("malformed", "survey", [(META, ("<gmd:MD_Metadata>",))], {18: "FAIL", 19: "FAIL", 22: "FAIL"}),
    ("other profile", "survey", ["UPDATE gpkg_metadata SET md_standard_uri = 'http://www.isotc211.org/2005/gmd'"], {18: "PASS*"}),
    ("type", "survey", ["UPDATE gpkg_metadata SET mime_type = 'text/plain' WHERE id = 7"], {19: "FAIL", 22: "FAIL"}),
    ("no anchor", "survey", ["DELETE FROM gpkg_metadata_reference WHERE reference_scope = 'geopackage'"], {19: "FAIL", 23: "FAIL"}),
    ("pair", "survey", ["UPDATE gpkg_metadata SET md_scope = 'feature' WHERE id = 7"], {19: "FAIL", 21: "FAIL", 22: "FAIL", 32: "FAIL"}),
    ("no column", "survey", ["ALTER TABLE gpkg_metadata DROP COLUMN mime_type"], {20: "FAIL", 32: "FAIL"}),
    ("no references", "survey", ["DROP TABLE gpkg_metadata_reference"], {19: "FAIL", 21: "FAIL", 23: "FAIL", 31: "FAIL", 32: "FAIL"}),
    ("orphan", "survey", ["INSERT INTO gpkg_metadata_reference VALUES ('row', 'wells', NULL, 1, '2024-05-06T07:08:09Z', 99, NULL)"], {21: "FAIL", 24: "FAIL"}),
    ("stamp", "survey", ["UPDATE gpkg_metadata_reference SET timestamp = 'noon' WHERE table_name = 'wells'"], {21: "FAIL"}),
    ("no product", "survey", ["UPDATE gpkg_metadata SET md_scope = 'model' WHERE id = 7"], {22: "FAIL", 31: "PASS"}),
    ("no table", "survey", ["INSERT INTO gpkg_contents VALUES ('moors', 'attributes', 'moors', '', '2024-05-06T07:08:09Z', NULL, NULL, NULL, NULL, 0)"], {24: "FAIL"}),
    ("undeclared layer", "survey", ["INSERT INTO gpkg_geometry_columns VALUES ('moors', 'geom', 'POINT', 4326, 0, 0)"], {24: "FAIL"}),
    ("no index", "survey", ["DROP TABLE rtree_wells_geom"], {24: "FAIL"}),
    ("stale index", "survey", ["INSERT INTO rtree_wells_geom VALUES (99, 1, 1, 1, 1)"], {24: "FAIL"}),
    ("beyond its box", "survey", ["UPDATE gpkg_contents SET max_x = 11 WHERE table_name = 'wells'"], {24: "FAIL"}),
    ("null shape", "survey", ["UPDATE wells SET geom = NULL WHERE fid = 2", "DELETE FROM rtree_wells_geom WHERE id = 2"], {24: "FAIL"}),
    ("other type", "survey", ["UPDATE gpkg_geometry_columns SET geometry_type_name = 'LINESTRING' WHERE table_name = 'wells'"], {24: "FAIL"}),
    ("members", "survey", [("UPDATE wells SET geom = ? WHERE fid = 1", (maker.blob(maker.many(4, maker.point(10, 50))),))], {24: "FAIL"}),
    ("any type", "survey", ["UPDATE gpkg_geometry_columns SET geometry_type_name = 'GEOMETRY' WHERE table_name = 'wells'", ("UPDATE wells SET geom = ? WHERE fid = 1", (maker.blob(maker.many(4, maker.point(10, 50))),))], {}),
    ("declared height", "survey", ["UPDATE gpkg_geometry_columns SET m = 1 WHERE table_name = 'wells'"], {24: "FAIL"}),
    ("garbled shape", "survey", [("UPDATE wells SET geom = ? WHERE fid = 1", (b"not a shape",))], {24: "FAIL"}),
    ("unlinked", "survey", ["DELETE FROM gpkg_metadata_reference WHERE table_name = 'wells'"], {32: "FAIL"}),
    ("other grid", "imagery", ["UPDATE gpkg_tile_matrix SET pixel_x_size = pixel_x_size * 1.3, pixel_y_size = pixel_y_size * 1.3"], {7: "FAIL"}),
    ("one step", "imagery", ["UPDATE gpkg_tile_matrix SET pixel_x_size = pixel_x_size * 1.1 WHERE zoom_level = 2"], {7: "FAIL", 27: "FAIL"}),
    ("order", "imagery", ["UPDATE gpkg_tile_matrix SET pixel_y_size = 1e9 WHERE zoom_level = 2"], {7: "FAIL", 28: "FAIL"}),
    ("raster system", "imagery", ["UPDATE gpkg_tile_matrix_set SET srs_id = 2056"], {7: "FAIL"}),
    ("cone", "imagery", ["INSERT INTO gpkg_spatial_ref_sys VALUES ('c', 2056, 'EPSG', 2056, 'x METHOD[\"Lambert Conic Conformal (2SP)\"] DATUM[\"WGS 84\"]', '-', 'undefined', NULL)", "UPDATE gpkg_tile_matrix_set SET srs_id = 2056"], {7: "PASS*", 13: "FAIL"}),
    ("tile width", "imagery", ["UPDATE gpkg_tile_matrix SET tile_width = 512 WHERE zoom_level = 0"], {8: "FAIL", 26: "FAIL", 29: "FAIL"}),
    ("gap", "imagery", ["UPDATE gpkg_tile_matrix SET zoom_level = 4 WHERE zoom_level = 2", "UPDATE scene SET zoom_level = 4 WHERE zoom_level = 2"], {7: "FAIL", 25: "FAIL"}),
    ("big picture", "imagery", [("UPDATE scene SET tile_data = ? WHERE id = 2", (maker.jpeg(512, before=90000),))], {26: "FAIL"}),
    ("no picture", "imagery", [("UPDATE scene SET tile_data = ? WHERE id = 2", (b"hello",))], {26: "FAIL"}),
    ("web picture", "imagery", [("UPDATE scene SET tile_data = ? WHERE id = 2", (b"RIFF\x10\0\0\0WEBPVP8L",))], {5: "FAIL", 26: "FAIL"}),
    ("png beside", "imagery", [("UPDATE scene SET tile_data = ? WHERE id = 2", (maker.png(256),))], {}),
    ("no tiles", "imagery", ["DELETE FROM scene"], {26: "PASS*"}),
    ("outside", "imagery", ["UPDATE gpkg_contents SET max_x = 3e7"], {30: "FAIL"}),
    ("turned box", "imagery", ["UPDATE gpkg_contents SET max_x = -1"], {30: "FAIL"}),
    ("tile document", "imagery", ["UPDATE gpkg_metadata SET md_standard_uri = '' WHERE id = 20"], {31: "FAIL"}),
    ("no matrix", "imagery", ["DROP TABLE gpkg_tile_matrix"], {24: "FAIL", 7: "PASS*", 8: "PASS", 25: "PASS", 26: "PASS", 27: "SKIPPED", 28: "SKIPPED", 29: "SKIPPED"}),
    ("coverage system", "relief", ["UPDATE gpkg_tile_matrix_set SET srs_id = 27700"], {11: "FAIL"}),
    ("coverage box", "relief", ["UPDATE gpkg_tile_matrix_set SET max_x = 999"], {11: "FAIL"}),
    ("not registered", "relief", ["DELETE FROM gpkg_extensions WHERE extension_name = 'gpkg_2d_gridded_coverage'"], {3: "FAIL", 33: "FAIL"}),
    ("no tile table", "relief", ["DROP TABLE gpkg_2d_gridded_tile_ancillary"], {33: "FAIL"}),
    ("field", "relief", ["UPDATE gpkg_2d_gridded_coverage_ancillary SET field_name = 'soil'"], {34: "FAIL"}),
    ("rain", "relief", ["UPDATE gpkg_2d_gridded_coverage_ancillary SET quantity_definition = 'Rain'"], {34: "SKIPPED", 35: "SKIPPED"}),
    ("corner", "relief", ["UPDATE gpkg_2d_gridded_coverage_ancillary SET grid_cell_encoding = 'grid-value-is-corner'"], {35: "FAIL"}),
    ("grid step", "relief", ["UPDATE gpkg_tile_matrix SET pixel_y_size = 0.2 WHERE zoom_level = 1"], {36: "FAIL"}),
    ("epoch", "relief", [("INSERT INTO gpkg_spatial_ref_sys VALUES ('d', 4979, 'EPSG', 4979, ?, '-', ?, 2015.0)", (SOLID.replace("ENSEMBLE", "DYNAMIC [ FrameEpoch [2010.0]],ENSEMBLE"),) * 2)], {17: "FAIL"}),
    ("same epoch", "relief", [("INSERT INTO gpkg_spatial_ref_sys VALUES ('d', 4979, 'EPSG', 4979, ?, '-', ?, 2010.0)", (SOLID.replace("ENSEMBLE", "DYNAMIC [ FrameEpoch [2010.0]],ENSEMBLE"),) * 2)], {17: "PASS"}),
    ("grid document", "relief", ["UPDATE gpkg_metadata SET metadata = '<a/>' WHERE id = 20"], {37: "FAIL", 32: "FAIL"}),
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("gpkg")
    for kind in maker.KINDS:
        maker.make(d / f"{kind}.gpkg", kind)
    for name, kind, statements, _ in SPOILED:
        maker.make(d / f"{name}.gpkg", kind, *statements)
    maker.make(d / "again.gpkg.gpkg", "survey")
    (d / "junk.gpkg").write_text("not a database")
    broken = bytearray(maker.make(d / "broken.gpkg", "imagery").read_bytes())
    broken[-8192:] = b"\xee" * 8192  # the last pages, of tiles
    (d / "broken.gpkg").write_bytes(broken)
    catalog = gpkg.read_catalog(spark, str(d)).written(str(d / "catalog"))
    requirements.evidence(catalog, AS_OF).write.parquet(str(d / "evidence"))
    rows = spark.read.parquet(str(d / "evidence"))
    findings(catalog, AS_OF, rows).write.parquet(str(d / "findings"))
    facts = spark.read.parquet(str(d / "findings"))
    statuses = {}
    for r in facts.collect():
        statuses.setdefault(r.file.rsplit("/", 1)[1], {})[r.req] = r.status
    return d, statuses, facts, rows, catalog


#: Statuses of the sound files where they are not SKIPPED.
SOUND = {
    "survey": {3: "PASS", 4: "PASS", 5: "PASS*", 9: "PASS*", 13: "PASS*", 14: "PASS*", 18: "PASS", 19: "PASS", 20: "PASS*", 21: "PASS", 22: "PASS", 23: "PASS*", 24: "PASS", 31: "PASS*", 32: "PASS"},
    "imagery": {3: "PASS", 4: "PASS", 5: "PASS*", 7: "PASS", 8: "PASS", 13: "PASS*", 14: "PASS*", 18: "PASS", 19: "PASS", 20: "PASS*", 21: "PASS", 22: "PASS", 23: "PASS*", 24: "PASS", 25: "PASS", 26: "PASS", 27: "PASS", 28: "PASS*", 29: "PASS*", 30: "PASS", 31: "PASS", 32: "PASS*"},
    "relief": {3: "PASS", 4: "PASS", 5: "PASS*", 11: "PASS", 13: "PASS*", 14: "PASS*", 18: "PASS", 19: "PASS", 20: "PASS*", 21: "PASS", 22: "PASS", 23: "PASS*", 24: "PASS", 25: "PASS", 26: "PASS", 27: "PASS", 28: "PASS*", 29: "PASS*", 30: "PASS", 31: "PASS*", 32: "PASS", 33: "PASS*", 34: "PASS", 35: "PASS", 36: "PASS", 37: "PASS"},
}


@pytest.mark.parametrize("kind", sorted(SOUND))
def test_sound_files(found, kind):
    _, statuses, *_ = found
    want = {r: SOUND[kind].get(r, "SKIPPED") for r in range(1, 38)}
    assert statuses[f"{kind}.gpkg"] == want
    assert kind != "survey" or statuses["again.gpkg.gpkg"] == want


@pytest.mark.parametrize("name,kind,want", [(n, k, w) for n, k, _, w in SPOILED])
def test_one_defect(found, name, kind, want):
    _, statuses, *_ = found
    sound = statuses[f"{kind}.gpkg"]
    assert {r: s for r, s in statuses[f"{name}.gpkg"].items() if s != sound[r]} == {r: s for r, s in want.items() if s != sound[r]}


def test_notes_and_verdicts(found):
    _, statuses, facts, rows, _ = found
    said = {(r.file.rsplit("/", 1)[1], r.req): r for r in facts.collect()}
    assert said["null shape.gpkg", 24].detail == "1 found: wells: null geometry" and said["survey.gpkg", 24].detail == ""
    assert said["ellipsoid.gpkg", 13].detail == "1 found: system 4326 differs in: ellipsoid" and said["third axis.gpkg", 13].detail == "1 found: system 4326 differs in: axes"
    few = {(r.file.rsplit("/", 1)[1], r.req): r.notes for r in examples(rows, 2).collect()}
    assert few["no references.gpkg", 31] == ["no table gpkg_metadata_reference", "no documents of layers"] and all(len(n) <= 2 for n in few.values())
    verdicts = {r.file.rsplit("/", 1)[1]: r.verdict for r in scoring.file_verdicts(facts).collect()}
    gate = {r.file.rsplit("/", 1)[1]: r for r in scoring.gate(facts).collect()}
    assert verdicts["survey.gpkg"] == "LIKELY CONFORMANT" and gate["survey.gpkg"].conformant and gate["survey.gpkg"].exit_code == 0
    assert verdicts["gap.gpkg"] == "NON-CONFORMANT" and not gate["gap.gpkg"].conformant


def test_damaged_files_are_errors_and_stop_nothing(spark, found):
    d, statuses, facts, _, catalog = found
    got = statuses["broken.gpkg"]
    assert {r for r, s in got.items() if s == "ERROR"} == set(range(1, 38)) - {1, 2, 6}
    assert catalog.files.filter("damage IS NOT NULL").count() == 1
    assert "junk.gpkg" not in statuses
    bad = gpkg.read_table(spark, str(d), "__files__").filter("not ok").collect()
    assert [r.file.rsplit("/", 1)[1] for r in bad] == ["junk.gpkg"] and "SQLite" in bad[0].error


def test_profile(found):
    *_, catalog = found
    got = {r.file.rsplit("/", 1)[1]: r for r in whole_profile(catalog).collect()}
    r = got["imagery.gpkg"]
    assert (r.categories, r.low, r.high, r.n_tiles, r.tile_sizes, r.tile_formats, r.factor) == ("tiles", 0, 2, 7, "256x256", "JPEG", 2.0)
    assert got["relief.gpkg"].grid_fields == "Height" and "gpkg_rtree_index" in got["survey.gpkg"].extensions and got["survey.gpkg"].n_tiles is None


def test_compatible_flags_take_an_envelope_for_height(spark, found):
    from cartolith.plans.validate import shape_facts

    d, *_ = found
    features = gpkg.read_table(spark, str(d / "survey.gpkg"), "__features__")
    count = lambda compat: shape_facts(features, compat=compat).filter("has_z").count()
    assert count(True) == 3 and count(False) == 0


def test_ranges_read_every_tile_once(spark, found, monkeypatch):
    d, *_ = found
    for table, drop in (("__tiles__", "tile_data"), ("__heads__", "format")):
        one = gpkg.read_table(spark, str(d / "imagery.gpkg"), table)
        many = gpkg.read_table(spark, str(d / "imagery.gpkg"), table, ranges=4)
        assert many.rdd.getNumPartitions() == 4 and sorted(one.drop(drop).collect()) == sorted(many.drop(drop).collect())
        assert one.count() == 7
    monkeypatch.setattr(gpkg, "RANGE_BYTES", 20000)
    size = (d / "imagery.gpkg").stat().st_size
    assert len(gpkg.GpkgReader({"path": str(d / "imagery.gpkg")}, "__tiles__").partitions()) == -(-size // 20000)


def test_write_then_validate(spark, tmp_path):
    from cartolith.functions.geometry import polygon_wkb
    from cartolith.plans.convert import convert_layers

    ring = F.array(*[F.array(F.col("id") + a, F.lit(b).cast("double")) for a, b in ((0.0, 0), (1.0, 0), (1.0, 1), (0.0, 1), (0.0, 0))])
    fields = spark.range(0, 20, 1, 2).select(polygon_wkb(ring).alias("geom"), F.concat(F.lit("n"), "id").alias("name"), F.unhex(F.lit("00")).alias("raw"))
    out = str(tmp_path / "out")
    got = convert_layers({"fields": fields, "more_fields": fields.limit(7)}, out, title="Fields", abstract="All the fields", stamp="2025-01-01T00:00:00Z", organisation="Land & Co")
    assert [(r["layer"], r["features"], r["geometries"], r["dropped_columns"]) for r in got] == [("fields", 20, 20, ["raw"]), ("more_fields", 7, 7, ["raw"])]
    catalog = gpkg.read_catalog(spark, out)
    assert not catalog.schema.filter("column_name = 'raw'").count()
    facts = findings(catalog, AS_OF).cache()
    assert facts.filter("status IN ('FAIL', 'ERROR')").count() == 0, facts.filter("status = 'FAIL'").collect()
    assert {r.status for r in facts.filter("req IN (18, 32)").collect()} == {"PASS"}
    parents = catalog.reference.filter("reference_scope = 'table'").select("md_parent_id").distinct().collect()
    assert [r[0] for r in parents] == [2]


def test_reports_and_command(spark, found, tmp_path, capsys):
    from cartolith.__main__ import main
    from cartolith.plans.report import quick_check, rollup_table, write_rollup

    d, *_, catalog = found
    folder = tmp_path / "some"
    folder.mkdir()
    for name in ("survey", "gap", "junk"):
        (folder / f"{name}.gpkg").write_bytes((d / f"{name}.gpkg").read_bytes())
    assert main(["validate", str(folder), "--output", str(tmp_path / "json"), "--as-of", AS_OF]) == 1
    said = capsys.readouterr().out
    assert "gap.gpkg: NON-CONFORMANT" in said and "junk.gpkg: not read" in said
    written = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert len(written) == 2 and all(len(x["requirements"]) == 37 and "detail" in x["requirements"][0] for x in written)
    quick = {r.file.rsplit("/", 1)[1]: r for r in quick_check(catalog).collect()}
    assert quick["survey.gpkg"].missing_systems == "" and quick["survey.gpkg"].compliant and not quick["imagery.gpkg"].compliant
    facts = spark.createDataFrame([("a", 3, "FAIL", "GDAL", 0, 0), ("b", 3, "PASS", "GDAL", 0, 0), ("a", 13, "PASS*", "GDAL", 2, 2)], "file string, req int, status string, software string, confirmed int, total_n int")
    assert [tuple(r) for r in rollup_table(facts).orderBy("Req").collect()] == [(3, "mandatory extensions", "M", 2, 1, 0, 0, 0, 50), (13, "definitions of systems", "M", 1, 0, 0, 1, 1, 0)]
    assert rollup_table(facts.withColumn("disputed", F.col("file") == "b")).filter("Req = 3").first()["Auditor Disputes"] == 1
    write_rollup(facts, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[1].startswith("3,mandatory extensions,M,2,1,0,0,0,50")
