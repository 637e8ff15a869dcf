"""Expressions over coordinate-system definitions, stamps, identifiers and metadata documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

LEVELS = ["UNCLASSIFIED", "RESTRICTED", "CONFIDENTIAL", "SECRET", "TOP SECRET"]
WKT2_ROOTS = ("GEOGCRS", "GEODCRS", "PROJCRS", "VERTCRS", "COMPOUNDCRS", "BOUNDCRS", "ENGCRS")


def last_epsg(wkt: Column) -> Column:
    """The last EPSG code in a definition: those of AUTHORITY come first, then those of ID."""
    found = F.concat(F.regexp_extract_all(wkt, F.lit(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]'), 1), F.regexp_extract_all(wkt, F.lit(r'ID\["EPSG",\s*(\d+)\]'), 1))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def axis_directions(wkt: Column) -> Column:
    """Axis directions in document order, for definitions that end an axis with its direction."""
    return F.array_join(F.transform(F.regexp_extract_all(wkt, F.lit(r'AXIS\["[^"]*",\s*([A-Za-z]+)\]'), 1), lambda x: F.upper(x)), ",")


def datum_name(wkt: Column) -> Column:
    """Name of the datum, or of the datum ensemble where there is no datum."""
    name = lambda key: F.nullif(F.trim(F.regexp_extract(wkt, rf'(?i){key}\["([^"]+)"', 1)), F.lit(""))
    return F.coalesce(name("DATUM"), name("ENSEMBLE"))


def frame_epoch(wkt: Column) -> Column:
    return F.nullif(F.regexp_extract(wkt, r"(?i)DYNAMIC\s*\[\s*FRAMEEPOCH\s*\[\s*([0-9.]+)", 1), F.lit("")).cast("double")


def is_wkt1(wkt: Column) -> Column:
    return wkt.rlike(r"^\s*(GEOGCS|PROJCS|VERT_CS|COMPD_CS|GEOCCS)\[")


def compound_problems(wkt: Column) -> Column:
    """What a compound definition lacks, comma-joined; empty if nothing."""
    upper = F.upper(wkt)
    issues = F.array(
        F.when(~upper.contains("COMPOUNDCRS["), "not compound"),
        F.when(~(upper.contains("GEOGCRS[") | upper.contains("PROJCRS[")), "no horizontal part"),
        F.when(~upper.contains("VERTCRS["), "no vertical part"),
        F.when(~upper.rlike(r"(?s)VERTCRS\[.*VDATUM\["), "no vertical datum"),
        F.when(is_wkt1(wkt), "WKT1"),
    )
    return F.array_join(issues, ",")


def is_dynamic(srs_id: Column, name: Column) -> Column:
    """Systems of the range 100100 to 100399, by their code or by a code in their name."""
    named = F.exists(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(?:crs|def)/([0-9]{6})"), 1), lambda x: x.cast("int").between(100100, 100399))
    return srs_id.between(100100, 100399) | named


def definition_problems(wkt: Column, srs_id: Column | None = None, name: Column | None = None) -> Column:
    """Rules for any definition, comma-joined: WKT1, prime meridian, degree unit, axis order, datum.

    With a code, a datum by another name than WGS 84 is a problem too unless the system is
    dynamic, as all allowed codes have that datum.
    """
    wkt = F.coalesce(wkt, F.lit(""))
    upper, datum, axes = F.upper(wkt), datum_name(wkt), F.split(axis_directions(wkt), ",")
    geographic = upper.rlike(r"(GEOGCRS|GEOGCS|GEODCRS|GEODETICCRS)\[")
    issues = [
        F.when(F.trim(wkt).isin("", "undefined"), "no definition"),
        F.when(upper.rlike(r"(GEOGCS|PROJCS|COMPD_CS)\["), "WKT1"),
        F.when(upper.contains("PRIMEM") & ~upper.contains("GREENWICH"), "prime meridian"),
        F.when(upper.contains("ANGLEUNIT") & ~upper.contains("DEGREE"), "no degree unit"),
        F.when(geographic & (F.get(axes, F.lit(0)) == "EAST") & (F.get(axes, F.lit(1)) == "NORTH"), "axis order"),
        F.when(~F.trim(wkt).isin("", "undefined") & datum.isNull(), "no datum"),
    ]
    if srs_id is not None:
        plain = F.trim(F.regexp_replace(F.upper(datum), r"[\s_-]+", " "))
        issues.append(F.when(~plain.isin(dims.WGS84_NAMES) & ~is_dynamic(srs_id, F.lit("") if name is None else name), "other datum"))
    return F.array_join(F.array(*issues), ",")


def is_uuid(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def is_stamp(x: Column) -> Column:
    """A date, or date and time with optional fraction and zone."""
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$"), F.lit(False))


def input_errors(title: Column, abstract: Column, security: Column, language: Column, nation: Column, languages: list[str], nations: list[str]) -> Column:
    """Problems of conversion inputs, comma-joined: lengths, and lists (languages in lower, nations in upper case)."""
    issues = F.array(
        F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) < 5, "title"),
        F.when(F.length(F.trim(F.coalesce(abstract, F.lit("")))) < 10, "abstract"),
        F.when(~F.coalesce(security.isin(LEVELS), F.lit(False)), "security"),
        F.when(~F.coalesce(F.lower(language).isin(languages), F.lit(False)), "language"),
        F.when(~F.coalesce(F.upper(nation).isin(nations), F.lit(False)), "nation"),
    )
    return F.array_join(issues, ",")


def elements_present(xml: Column) -> Column:
    """How many of the seven mandatory elements a document opens, by local name."""
    hits = [F.when(xml.rlike(rf"<(?:[A-Za-z0-9_]+:)?{e}[\s/>]"), 1).otherwise(0) for e in dims.MANDATORY_ELEMENTS]
    return F.coalesce(sum(hits[1:], hits[0]), F.lit(0))


def scope_code(xml: Column) -> Column:
    """Attribute or text of the first scope code."""
    attribute = F.regexp_extract(xml, r'<(?:\w+:)?MD_ScopeCode[^>]*codeListValue="([^"]*)"', 1)
    body = F.regexp_extract(xml, r"<(?:\w+:)?MD_ScopeCode[^>]*>([^<]*)<", 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(F.trim(body), F.lit("")))


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
