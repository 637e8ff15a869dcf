"""Conversion of feature layers: flatten, reproject, describe, write.

The pipeline is a chain of column expressions over one scan; rows whose geometry cannot be
read keep their attributes, lose their geometry and are counted, as a bad feature must not
stop a layer.  Invalid geometries are written as they are; validation reports them.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import binary, crs, geometry, transform, xml
from ..sources import gpkg


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: ``file``, ``geom`` (well-known binary) and ``properties`` as JSON text.

    A file is a collection, one feature or one geometry (read in one task), or features line by
    line (with or without record separators), which are read in parts.  Anything else is an error
    that names the file.
    """
    files = gpkg.find_files(path, suffix=".geojson") if os.path.isdir(path) else gpkg.find_files(path)
    if not files:
        raise ValueError(f"no such files: {path}")
    lines = [f for f in files if _by_line(f)]
    whole = [f for f in files if f not in set(lines)]
    parts, one = [], "type string, geometry string, properties string, coordinates string"
    if lines:
        text = spark.read.text(lines).select(F.col("_metadata.file_path").alias("file"), F.ltrim("value", F.lit("\x1e \t")).alias("t")).filter("trim(t) <> ''")
        parts.append(text.select("file", F.from_json("t", one).alias("f")))
    if whole:
        raw = spark.read.option("multiLine", True).schema(f"{one}, features array<struct<{one.replace(' string', ': string')}>>").json(whole)
        raw = raw.select(F.col("_metadata.file_path").alias("file"), "*")
        single = F.array(F.struct("type", "geometry", "properties", "coordinates"))
        parts.append(raw.select("file", F.explode(F.when(F.col("type") == "FeatureCollection", F.coalesce("features", F.array().cast(raw.schema["features"].dataType))).otherwise(single)).alias("f")))
    rows = reduce(DataFrame.unionByName, parts)
    bare = F.concat(F.lit('{"type":"'), F.col("f.type"), F.lit('","coordinates":'), F.col("f.coordinates"), F.lit("}"))
    shape = F.when(F.col("f.type") == "Feature", F.col("f.geometry")).when(F.col("f.type").isin(*_CODES) & F.col("f.coordinates").isNotNull(), bare)
    known = F.col("f.type").isin("Feature", *_CODES)
    shape = F.when(known, shape).otherwise(F.raise_error(F.concat(F.lit("no GeoJSON feature in "), "file")))
    return rows.select("file", _from_geojson(shape).alias("geom"), F.col("f.properties").alias("properties"))


def _by_line(path: str) -> bool:
    """Whether a file has a feature a line: its first line is one, and there is more."""
    with open(path, "rb") as f:
        first, more = f.readline(64 << 20).lstrip(b"\xef\xbb\xbf\x1e \t"), f.readline(1 << 16)
    try:
        return json.loads(first).get("type") == "Feature" and (bool(more.strip()) or first.endswith(b"\n"))
    except (ValueError, AttributeError):
        return False


_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}


def geojson_wkb(text: str | None) -> bytes | None:
    """Two-dimensional well-known binary of a GeoJSON geometry; null for null or unknown types."""
    import json

    if not text:
        return None
    g = json.loads(text)
    return _wkb(g.get("type"), g.get("coordinates")) if g else None


def _wkb(kind: str, c) -> bytes | None:
    if kind not in _CODES or c is None:
        return None
    line = lambda p: struct.pack("<I", len(p)) + np.array([q[:2] for q in p], "<f8").tobytes()
    head = struct.pack("<BI", 1, _CODES[kind])
    if kind == "Point":
        return head + struct.pack("<2d", *c[:2])
    if kind == "LineString":
        return head + line(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
    return head + struct.pack("<I", len(c)) + b"".join(_wkb(kind.removeprefix("Multi"), x) for x in c)


@F.pandas_udf(T.BinaryType())
def _from_geojson(x: pd.Series) -> pd.Series:
    return x.map(geojson_wkb)


def reproject_points(df: DataFrame, lon: str, lat: str, srs_id: int) -> DataFrame:
    """``x, y`` of points in a closed-form system, as expressions without Python."""
    x, y = crs.project(F.col(lon), F.col(lat), srs_id)
    return df.withColumns({"x": x, "y": y})


def layer_type(df: DataFrame) -> str:
    """The layer's geometry type: that of all its geometries if they agree, else GEOMETRY; one grouped pass over all rows."""
    h = F.hex(F.substring("geom", 1, 5))
    code = binary.number(h, 1, 4, binary.at(h, 0, 1) == "01")
    found = df.filter("geom IS NOT NULL").select(geometry.geometry_type(code).alias("t")).distinct().limit(2).collect()
    return found[0].t if len(found) == 1 and found[0].t else "GEOMETRY"


def input_warnings(srs_id: int | None, kind: str) -> list[str]:
    """Policy of the converting side for a layer's system; ``any`` allows what some data type may use."""
    if srs_id is None:
        return ["no coordinate system"]
    allowed = dims.APPROVED if kind == "any" else dims.CONVERT[kind]
    return [] if srs_id in allowed else [f"EPSG:{srs_id} is not allowed for {kind}"]


def target_system(srs_id: int | None, mode: str = "a", target: int = 4326) -> int:
    """The system to write: mode ``a`` keeps an approved one and takes 4326 else; ``b`` takes ``target``; ``keep`` keeps any."""
    if mode not in ("a", "b", "keep"):
        raise ValueError(f"unknown mode {mode}")
    if srs_id is None:
        srs_id = 4326
    return target if mode == "b" else srs_id if mode == "keep" or srs_id in dims.APPROVED else 4326


def with_profile(profile: str = "default", **given) -> dict:
    """What the caller gave, completed by a profile's settings; ValueError for an unknown profile."""
    if profile not in dims.PROFILES:
        raise ValueError(f"unknown profile {profile}; one of {', '.join(sorted(dims.PROFILES))}")
    return dims.PROFILES[profile] | {k: v for k, v in given.items() if v is not None}


def _title(layer: Column) -> Column:
    """A layer's name as a title: underscores to spaces, letters after anything but a letter in capitals."""
    words = F.transform(F.regexp_extract_all(F.translate(layer, "_", " "), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(words, "")


def convert_layers(
    layers: dict[str, DataFrame], path: str, *, title: str, abstract: str, stamp: str, srs_id: int = 4326, mode: str = "keep", target: int = 4326, profile: str = "default",
    language: str | None = None, organisation: str = "", identifier: str = "", wkt2: str | None = None, file: str | None = None,
) -> list[dict]:
    """Write layers (``geom``, well-known binary in ``srs_id``, and attributes) into GeoPackages below ``path``.

    Each task writes one file that has all layers; with ``file`` there is one file of that name
    with all layers and rows.  Binary attributes are dropped, geometries
    flattened and brought into the system that ``mode`` says.  The files hold a document of
    the metadata profile, one of the package, and one of each layer below it.  Returns what
    this job wrote of each layer, as its tasks counted it; ``lost`` counts geometries that could
    not be read.
    """
    spark = next(iter(layers.values())).sparkSession
    gpkg.register(spark)
    settings = with_profile(profile, language=language)
    system, lit = target_system(srs_id, mode, target), F.lit
    reported, parts, described = [], [], []
    for name, df in layers.items():
        drop = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType) and f.name != "geom"]
        flat = df.drop(*drop).withColumn("geom", transform.reproject(geometry.flatten2d(F.col("geom")), srs_id, system))
        counts = df.select(F.count("*").alias("n"), F.count("geom").alias("g")).first()
        reported.append({"layer": name, "features": counts.n, "given": counts.g, "dropped_columns": drop})
        described.append({"name": name, "geometry_type": layer_type(df), "columns": [(f.name, f.dataType.typeName()) for f in flat.schema.fields if f.name not in ("geom", "fid")]})
        parts.append(flat.select("geom", F.to_json(F.struct(*[F.col(f"`{c}`") for c, _ in described[-1]["columns"]]) if described[-1]["columns"] else F.struct(lit(0).alias("_"))).alias("attributes"), lit(name).alias("layer")))
    text = lambda i, t, a, scope: xml.metadata_document(lit(i), t, lit(a), lit(settings["language"]), lit(stamp), scope, lit(organisation))
    heads = [text(identifier or title, lit(title), abstract, "dataset").alias("d0"), text(f"{identifier or title} package", lit(title), abstract, "dataset").alias("d1")]
    rows = spark.range(1).select(*heads, *[text(name, _title(lit(name)), f"Layer {name} of {title}", "featureType").alias(f"l{i}") for i, name in enumerate(layers)]).first()
    documents = [{"scope": "dataset", "uri": dims.PROFILE_URI, "xml": rows.d0}, {"scope": "dataset", "uri": "http://www.isotc211.org/2005/gmd", "xml": rows.d1}]
    documents += [{"scope": "featureType", "uri": "http://www.isotc211.org/2005/gmd", "xml": rows[f"l{i}"], "table": name, "parent": 2} for i, name in enumerate(layers)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    job = uuid.uuid4().hex
    options = dict(path=path, job=job, srs_id=str(system), wkt2=dims.WKT2.get(system, "undefined") if wkt2 is None else wkt2, last_change=stamp, layers=json.dumps(described), documents=json.dumps(documents))
    if file is None:
        merged.write.format("gpkg").mode("append").options(**options).save()
    else:
        gpkg.write_files(merged.withColumn("_file", lit(file)), file_column="_file", **options)
    with open(os.path.join(path, f"_written-{job}.json")) as f:
        found = json.load(f)["layers"]
    return [{"layer": r["layer"], "features": found[r["layer"]][0], "geometries": found[r["layer"]][1], "lost": r["given"] - found[r["layer"]][1], "dropped_columns": r["dropped_columns"], "srs_id": system} for r in reported]


def convert_layer(df: DataFrame, path: str, *, layer: str, **settings) -> dict:
    """``convert_layers`` of one layer."""
    return convert_layers({layer: df}, path, **settings)[0]


def convert_geopackage(spark: SparkSession, source: str, path: str, *, title: str, abstract: str, stamp: str, layers: list[str] | None = None, **settings) -> list[dict]:
    """Feature layers of GeoPackages, with typed attributes and from their own systems, into new ones.

    A layer that several files have is one layer of all their rows; they must agree on its system.
    """
    listed = gpkg.list_layers(spark, source).filter(F.col("geometry_column").isNotNull()).groupBy("table_name").agg(F.collect_set("srs_id").alias("s")).orderBy("table_name").collect()
    systems = {r.table_name: r.s for r in listed if layers is None or r.table_name in layers}
    if lacking := set(layers or []) - set(systems):
        raise ValueError("no such layer: " + ", ".join(sorted(lacking)))
    if mixed := [n for n, s in systems.items() if len(s) != 1]:
        raise ValueError("files disagree on the system of " + ", ".join(mixed))
    by_system: dict[int, dict[str, DataFrame]] = {}
    for name, (srs,) in systems.items():
        by_system.setdefault(srs, {})[name] = gpkg.read_layer(spark, source, name).drop("file", "fid")
    out = []
    for srs, some in by_system.items():  # a file has one system: layers of another one get files of their own
        target = {"file": f"{settings['file']}-{srs}" if len(by_system) > 1 else settings["file"]} if settings.get("file") else {}
        out += convert_layers(some, path, title=title, abstract=abstract, stamp=stamp, srs_id=srs, **settings | target)
    return out


def summary(results: list[dict], seconds: float) -> dict:
    """Totals of ``convert_layers``: layers, features, lost geometries and features a second."""
    n = sum(r["features"] for r in results)
    return {"layers": len(results), "features": n, "lost": sum(r["lost"] for r in results), "seconds": seconds, "features_per_second": n / seconds if seconds > 0 else None}
