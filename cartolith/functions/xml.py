"""XML as columns: well-formedness and the facts of a metadata document, parsed in Arrow batches; documents to write."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims


@F.pandas_udf(T.BooleanType())
def _parses(x: pd.Series) -> pd.Series:
    from xml.parsers import expat

    def one(s):
        if not s:
            return False
        try:
            p = expat.ParserCreate()
            p.Parse(s, True)
        except expat.ExpatError:
            return False
        return True

    return x.map(one)


def well_formed(x: Column) -> Column:
    """Whether a text is one well-formed document; null and empty texts are not.

    ``xpath`` functions stop the job on a malformed text, so they need this test first.
    """
    return _parses(x)


FACTS = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("children", T.ArrayType(T.StringType())),
        T.StructField("n_mandatory", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("identifier", "language", "charset", "scope", "organisation", "role", "stamp")],
    ]
)


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _said(element) -> str | None:
    """The first text in an element or below it."""
    return next((t.strip() for t in element.itertext() if t.strip()), None) if element is not None else None


def document_facts(text: str | None) -> dict:
    """What the metadata rules read in a document: children of the root, mandatory elements, and the fields by local name.

    ``n_mandatory`` counts elements anywhere whose name contains that of a mandatory one.  A
    code (character set, scope, role, language) is its ``codeListValue`` or else its text.
    """
    out = dict.fromkeys(f.name for f in FACTS.fields)
    out.update(ok=False, children=[], n_mandatory=0)
    if not text or not text.strip():
        return out
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return out
    first: dict = {}
    for e in root.iter():
        name = _local(e)
        if e is not root:
            first.setdefault(name, e)
        out["n_mandatory"] += any(m in name for m in dims.MANDATORY_ELEMENTS)
    code = lambda name: (first[name].get("codeListValue") or _said(first[name])) if name in first else None
    out.update(
        ok=True, namespace=root.tag[1:].split("}", 1)[0] if root.tag.startswith("{") else "", children=[_local(e) for e in root],
        identifier=_said(first.get("fileIdentifier")), language=_said(first.get("language")) or code("LanguageCode"), charset=code("MD_CharacterSetCode") or _said(first.get("characterSet")),
        scope=code("MD_ScopeCode") or _said(first.get("hierarchyLevel")), organisation=_said(first.get("organisationName")), role=code("CI_RoleCode"), stamp=_said(first.get("dateStamp")),
    )
    return out


@F.pandas_udf(FACTS)
def _facts(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([document_facts(s) for s in x], columns=[f.name for f in FACTS.fields])


def facts(x: Column) -> Column:
    """Struct ``FACTS`` of a document; ``ok`` is false and the rest empty where it cannot be parsed."""
    return _facts(x)


def field_problems(fact: Column) -> Column:
    """What a document of the metadata profile lacks, comma-joined: the seven fields, and children beyond the profile's schema."""
    get = fact.getField
    missing = lambda name: get(name).isNull()
    children = get("children")
    allowed = F.array(*[F.lit(e) for e in (*dims.MANDATORY_ELEMENTS, *dims.OPTIONAL_ELEMENTS)])
    needed = F.array(*[F.lit(e) for e in dims.MANDATORY_ELEMENTS])
    issues = F.array(
        F.when(~get("ok"), "not well-formed"),
        *[
            F.when(get("ok") & bad, label)
            for bad, label in (
                (missing("identifier"), "fileIdentifier"),
                (missing("language") | ~get("language").rlike("^[a-z]{3}$"), "language"),
                (missing("charset") | ~get("charset").isin(dims.CHARSETS), "characterSet"),
                (missing("scope") | ~get("scope").isin(dims.SCOPE_CODES), "hierarchyLevel"),
                (missing("organisation"), "organisationName"),
                (missing("role"), "role"),
                (missing("stamp") | ~get("stamp").rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})(T?\d{2}:?\d{2}:?\d{2}(Z|[+-]\d{2}:?\d{2})?)?$"), "dateStamp"),
                (F.size(F.array_except(needed, children)) > 0, "schema: missing"),
                (F.size(F.array_except(children, allowed)) > 0, "schema: unknown"),
                (F.size(F.array_distinct(children)) < F.size(children), "schema: repeated"),
            )
        ],
    )
    return F.array_join(issues, ",")


def metadata_document(identifier: Column, title: Column, abstract: Column, language: Column, stamp: Column, scope: str = "dataset", organisation: Column | None = None, extent: Column | None = None) -> Column:
    """A metadata document with the mandatory elements in the schema's order, from columns; values are escaped.

    ``extent``, a struct of min_x, min_y, max_x and max_y in degrees, adds a bounding box.
    """
    from .text import escaped

    lit, text = F.lit, lambda x: F.concat(F.lit("<gco:CharacterString>"), escaped(F.coalesce(x, F.lit(""))), F.lit("</gco:CharacterString>"))
    value = lambda name, x: F.concat(F.lit(f"<gmd:{name}>"), text(x), F.lit(f"</gmd:{name}>"))
    edges = (("westBoundLongitude", "min_x"), ("eastBoundLongitude", "max_x"), ("southBoundLatitude", "min_y"), ("northBoundLatitude", "max_y"))
    if extent is None:
        box = lit("")
    else:
        sides = [F.concat(lit(f"<gmd:{n}><gco:Decimal>"), extent[c].cast("string"), lit(f"</gco:Decimal></gmd:{n}>")) for n, c in edges]
        box = F.coalesce(F.concat(lit("<gmd:extent><gmd:EX_GeographicBoundingBox>"), *sides, lit("</gmd:EX_GeographicBoundingBox></gmd:extent>")), lit(""))
    return F.concat(
        lit('<gmd:MD_Metadata xmlns:gmd="http://www.isotc211.org/2005/gmd" xmlns:gco="http://www.isotc211.org/2005/gco">'),
        value("fileIdentifier", identifier),
        value("language", language),
        lit('<gmd:characterSet><gmd:MD_CharacterSetCode codeListValue="utf8">utf8</gmd:MD_CharacterSetCode></gmd:characterSet>'),
        lit(f'<gmd:hierarchyLevel><gmd:MD_ScopeCode codeListValue="{scope}">{scope}</gmd:MD_ScopeCode></gmd:hierarchyLevel><gmd:contact><gmd:CI_ResponsibleParty>'),
        value("organisationName", F.lit("unknown") if organisation is None else F.coalesce(F.nullif(organisation, lit("")), lit("unknown"))),
        lit('<gmd:role><gmd:CI_RoleCode codeListValue="pointOfContact">pointOfContact</gmd:CI_RoleCode></gmd:role></gmd:CI_ResponsibleParty></gmd:contact><gmd:dateStamp><gco:DateTime>'),
        stamp, lit("</gco:DateTime></gmd:dateStamp><gmd:identificationInfo><gmd:MD_DataIdentification>"),
        value("title", title), value("abstract", abstract), box,
        lit("</gmd:MD_DataIdentification></gmd:identificationInfo></gmd:MD_Metadata>"),
    )
