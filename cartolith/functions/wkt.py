"""Coordinate-system definitions as trees: facts of WKT1 and WKT2 in one canonical form, comparison and detection.

A definition is read into a tree of keywords and values; the facts that make up a system (kind,
axes, ellipsoid, prime meridian, method and parameters in metres and degrees) are taken from it
under names that both versions share.  Systems are equal if their facts are, whatever they are
called.  The allowed systems are described by rule, so a definition without a code, as in a
``.prj`` file, finds its code by its facts.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache
from math import degrees, isclose, radians

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([\[\](),]))')
#: Deepest nesting that is read.
DEPTH = 60
KINDS = {
    "GEOGCRS": "geographic", "GEOGRAPHICCRS": "geographic", "GEOGCS": "geographic", "GEODCRS": "geodetic", "GEODETICCRS": "geodetic", "GEOCCS": "geodetic", "PROJCRS": "projected", "PROJECTEDCRS": "projected", "PROJCS": "projected",
    "VERTCRS": "vertical", "VERTICALCRS": "vertical", "VERT_CS": "vertical", "COMPOUNDCRS": "compound", "COMPD_CS": "compound", "BOUNDCRS": "bound", "ENGCRS": "engineering", "LOCAL_CS": "engineering",
}
#: One name for the methods and parameters of both versions; spelling is compared without case and marks (fixed values).
METHODS = {
    "transversemercator": "transverse mercator", "mercatorvarianta": "mercator", "mercator1sp": "mercator", "mercator": "mercator", "popularvisualisationpseudomercator": "pseudo mercator",
    "mercatorauxiliarysphere": "pseudo mercator", "polarstereographicvarianta": "polar stereographic", "polarstereographic": "polar stereographic", "stereographicnorthpole": "polar stereographic",
    "stereographicsouthpole": "polar stereographic", "lambertconformalconic2sp": "conic 2", "lambertconicconformal2sp": "conic 2", "lambertconicconformal1sp": "conic 1", "lambertconformalconic1sp": "conic 1",
}
PARAMETERS = {
    "latitudeofnaturalorigin": "lat", "latitudeoforigin": "lat", "latitudeoffalseorigin": "lat", "longitudeofnaturalorigin": "lon", "centralmeridian": "lon", "longitudeoffalseorigin": "lon", "longitudeoforigin": "lon",
    "straightverticallongitudefrompole": "lon", "scalefactoratnaturalorigin": "scale", "scalefactor": "scale", "falseeasting": "east", "eastingatfalseorigin": "east", "falsenorthing": "north", "northingatfalseorigin": "north",
    "standardparallel1": "parallel 1", "latitudeof1ststandardparallel": "parallel 1", "standardparallel2": "parallel 2", "latitudeof2ndstandardparallel": "parallel 2", "auxiliaryspheretype": "sphere",
}
_ANGLES = {"lat", "lon", "parallel 1", "parallel 2"}


class Node:
    """A keyword with its values: texts, numbers, bare words and nodes."""

    def __init__(self, key: str):
        self.key, self.values = key.upper(), []

    def all(self, *keys: str) -> list["Node"]:
        return [v for v in self.values if isinstance(v, Node) and v.key in keys]

    def first(self, *keys: str) -> "Node | None":
        return next(iter(self.all(*keys)), None)

    def find(self, *keys: str) -> "Node | None":
        """The first node of a keyword at any depth, in document order."""
        for v in self.values:
            if isinstance(v, Node):
                found = v if v.key in keys else v.find(*keys)
                if found is not None:
                    return found
        return None

    def numbers(self) -> list[float]:
        return [v for v in self.values if isinstance(v, float)]


def parse(text: str) -> Node:
    """The tree of a definition; ValueError says what is wrong with it."""
    at, stack, done, word = 0, [], None, None
    text = text or ""
    while at < len(text.rstrip()):
        if done is not None:
            raise ValueError("text after the end")
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unreadable at {at + 1}")
        string, name, number, mark = m.groups()
        at = m.end()
        if mark in ("[", "("):
            if word is None:
                raise ValueError("a bracket without a keyword")
            if len(stack) >= DEPTH:
                raise ValueError("nested too deeply")
            node = Node(word)
            if stack:
                stack[-1].values[-1] = node
            stack.append(node)
            word = None
            continue
        word = None
        if mark in ("]", ")"):
            if not stack:
                raise ValueError("a bracket that nothing opens")
            node = stack.pop()
            done = node if not stack else None
        elif mark is None:
            if not stack and name is None:
                raise ValueError("a value without a keyword")
            word = name
            if stack:
                stack[-1].values.append(string.replace('""', '"') if string is not None else float(number) if number is not None else name)
    if done is None:
        raise ValueError("a bracket that nothing closes" if stack else "no definition")
    return done


def _plain(name) -> str:
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def _factor(node: Node | None, *keys: str) -> float | None:
    unit = node.first(*keys) if node else None
    return unit.numbers()[0] if unit and unit.numbers() else None


def facts(text: str) -> dict:
    """Facts of a definition: ``kind, axes, axis_count, code, datum, a, rf, meridian, method, parameters``; ``error`` if it cannot be read.

    A compound system has the facts of its horizontal part, ``axes`` of all parts and the ``vertical`` datum.
    """
    try:
        root = parse(text)
    except ValueError as e:
        return {"error": str(e)}
    if root.key not in KINDS:
        return {"error": f"{root.key} is no system"}
    kind, main = KINDS[root.key], root
    if kind == "bound":
        source = root.first("SOURCECRS")
        main = next((v for v in source.values if isinstance(v, Node)), root) if source else root
        kind = KINDS.get(main.key, kind)
    if kind == "compound":
        parts = [v for v in main.values if isinstance(v, Node) and v.key in KINDS]
        horizontal = next((p for p in parts if KINDS[p.key] != "vertical"), main)
    else:
        parts, horizontal = [main], main
    axes = [_direction(a) for p in parts for a in p.all("AXIS")]
    declared = sum(int(cs.numbers()[0]) for p in parts if (cs := p.first("CS")) and cs.numbers())
    count = max(len(axes), declared) or {"geographic": 2, "projected": 2, "vertical": 1, "geodetic": 3, "compound": 3}.get(kind, 0)
    if kind == "geodetic":
        kind = "geocentric" if (cs := horizontal.first("CS")) is None or str(cs.values[0]).lower() == "cartesian" else "geographic"
    datum = horizontal.find("DATUM", "GEODETICDATUM", "TRF", "ENSEMBLE", "VDATUM", "VRF", "VERT_DATUM", "VERTICALDATUM")
    ball = horizontal.find("ELLIPSOID", "SPHEROID")
    upright = next((p for p in parts if KINDS[p.key] == "vertical"), None)
    level = upright.find("VDATUM", "VRF", "VERT_DATUM", "VERTICALDATUM", "ENSEMBLE") if upright else None
    code = next((v for n in (root.first("ID", "AUTHORITY"),) if n and str(n.values[0]).upper() == "EPSG" for v in n.values[1:2]), None)
    base = horizontal.first("BASEGEOGCRS", "BASEGEODCRS", "GEOGCS") or horizontal
    turn = _factor(base, "UNIT", "ANGLEUNIT") if horizontal.key == "PROJCS" else None
    meridian = horizontal.find("PRIMEM", "PRIMEMERIDIAN")
    out = {
        "kind": kind, "axes": axes, "axis_count": count, "code": int(float(code)) if code is not None and re.fullmatch(r"\d+(\.0)?", str(code)) else None, "datum": datum.values[0] if datum and datum.values else None,
        "a": ball.numbers()[0] * (_factor(ball, "LENGTHUNIT", "UNIT") or 1.0) if ball and ball.numbers() else None, "rf": ball.numbers()[1] if ball and len(ball.numbers()) > 1 else None,
        "meridian": degrees(meridian.numbers()[0] * (_factor(meridian, "ANGLEUNIT", "UNIT") or radians(1))) if meridian and meridian.numbers() else None, "method": None, "parameters": {},
        "vertical": level.values[0] if level and level.values else None,
    }
    if kind == "projected" or KINDS.get(horizontal.key) == "projected":
        conversion = horizontal.first("CONVERSION") or horizontal
        method = conversion.first("METHOD", "PROJECTION")
        name = _plain(method.values[0]) if method and method.values else None
        out["method"] = METHODS.get(name, name)
        metre = _factor(horizontal, "UNIT", "LENGTHUNIT") if horizontal.key == "PROJCS" else None
        for p in conversion.all("PARAMETER"):
            key = PARAMETERS.get(_plain(p.values[0]), _plain(p.values[0]))
            value = p.numbers()[0] if p.numbers() else None
            if value is None or key == "sphere":
                continue
            unit = _factor(p, "ANGLEUNIT", "LENGTHUNIT", "SCALEUNIT", "UNIT")
            if key in _ANGLES:
                value = degrees(value * (unit or turn or radians(1)))
            elif key in ("east", "north"):
                value *= unit or metre or 1.0
            out["parameters"][key] = value
    return out


def _direction(axis: Node) -> str:
    words = [v for v in axis.values[1:] if isinstance(v, str)]
    return words[0].lower() if words else ""


@cache
def registry() -> dict[int, dict]:
    """Facts of the allowed systems, by rule: all of them are of the datum WGS 84."""
    base = {"datum": "World Geodetic System 1984", "a": dims.WGS84_A, "rf": 1 / dims.WGS84_F, "meridian": 0.0, "method": None, "parameters": {}, "vertical": None}
    flat, map_ = {"axes": ["north", "east"], "axis_count": 2}, {"kind": "projected", "axes": ["east", "north"], "axis_count": 2}
    place = lambda lat, lon, scale, east, north: {"lat": float(lat), "lon": float(lon), "scale": scale, "east": east, "north": north}
    out = {
        4326: base | flat | {"kind": "geographic"}, 4979: base | {"kind": "geographic", "axes": ["north", "east", "up"], "axis_count": 3}, 4978: base | {"kind": "geocentric", "axes": ["geocentricx", "geocentricy", "geocentricz"], "axis_count": 3},
        9518: base | {"kind": "compound", "vertical": "EGM2008 geoid", "axes": ["north", "east", "up"], "axis_count": 3}, 3857: base | map_ | {"method": "pseudo mercator", "parameters": place(0, 0, 1.0, 0.0, 0.0)},
        3395: base | map_ | {"method": "mercator", "parameters": place(0, 0, 1.0, 0.0, 0.0)},
        5041: base | map_ | {"axes": ["south", "south"], "method": "polar stereographic", "parameters": place(90, 0, 0.994, 2e6, 2e6)}, 5042: base | map_ | {"axes": ["north", "north"], "method": "polar stereographic", "parameters": place(-90, 0, 0.994, 2e6, 2e6)},
    }
    for z in range(1, 61):
        for code, north in ((32600 + z, 0.0), (32700 + z, 1e7)):
            out[code] = base | map_ | {"method": "transverse mercator", "parameters": place(0, 6 * z - 183, 0.9996, 5e5, north)}
    return {code: f | {"code": code} for code, f in out.items()}


#: What a parameter is where a definition leaves it out.
_DEFAULT = {"lat": 0.0, "lon": 0.0, "scale": 1.0, "east": 0.0, "north": 0.0}


def differences(f: dict, g: dict) -> list[str]:
    """What makes two systems different: kind, axes, axis order, ellipsoid, prime meridian, vertical datum, method, parameters.  What one of them leaves open is no difference."""
    out = []
    near = lambda x, y, tolerance: x is None or y is None or isclose(x, y, rel_tol=tolerance, abs_tol=tolerance)
    if f["kind"] != g["kind"]:
        out.append("kind")
    if f["axis_count"] != g["axis_count"]:
        out.append("axes")
    elif f["axes"] and g["axes"] and f["axes"] != g["axes"]:
        out.append("axis order")
    if not (near(f["a"], g["a"], 1e-9) and near(f["rf"], g["rf"], 1e-9)):
        out.append("ellipsoid")
    if not near(f["meridian"], g["meridian"], 1e-9):
        out.append("prime meridian")
    if f["vertical"] and g["vertical"] and _plain(f["vertical"]) != _plain(g["vertical"]):
        out.append("vertical datum")
    if f["method"] != g["method"]:
        out.append("method")
    elif f["method"] and any(not near(f["parameters"].get(k, _DEFAULT.get(k)), g["parameters"].get(k, _DEFAULT.get(k)), 1e-8) for k in {*f["parameters"], *g["parameters"]}):
        out.append("parameters")
    return out


@lru_cache(1024)
def problems(text: str | None, srs_id: int | None) -> str | None:
    """Differences of a definition from the system that its code stands for, comma-joined: ``unreadable``, ``code`` and those of ``differences``.

    Empty for an equal system, null for a code outside the registry or a missing definition.
    """
    if srs_id not in registry() or not (text or "").strip() or text.strip().lower() == "undefined":
        return None
    f = facts(text)
    if "error" in f:
        return "unreadable"
    return ",".join((["code"] if f["code"] is not None and f["code"] != srs_id else []) + differences(f, registry()[srs_id]))


def identify(text: str | None) -> int | None:
    """The code of a definition: the one that it names if its facts do not speak against it, else the one system of the registry with its facts up to axis order."""
    f = facts(text or "")
    if "error" in f:
        return None
    known = registry()
    fits = lambda g: not set(differences(f, g)) - {"axis order"}
    if f["code"] is not None:
        return f["code"] if f["code"] not in known or fits(known[f["code"]]) else None
    if f["a"] is None or f["datum"] is None or not re.search(r"wgs ?_?(19)?84|worldgeodeticsystem1984", _plain(f["datum"]) + " " + str(f["datum"]).lower()):
        return None
    found = [code for code, g in known.items() if fits(g) and (f["vertical"] is None) == (g["vertical"] is None)]
    return found[0] if len(found) == 1 else None


@F.pandas_udf(T.StringType())
def _problems(text: pd.Series, srs_id: pd.Series) -> pd.Series:
    return pd.Series([problems(t, None if pd.isna(s) else int(s)) for t, s in zip(text, srs_id)], dtype=object)


@F.pandas_udf(T.IntegerType())
def _identify(text: pd.Series) -> pd.Series:
    return pd.Series([identify(t) for t in text], dtype="Int32")


def structure_problems(text: Column, srs_id: Column) -> Column:
    return _problems(text, srs_id)


def code_of(text: Column) -> Column:
    return _identify(text)
