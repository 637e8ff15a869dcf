"""Content models of metadata elements, compiled to automata over sequences of children, as column expressions.

A model is a sequence of names with how often each may occur.  Its automaton has a state for
each place of the sequence: a child at a later place moves on, one at the same place stays (and
is *repeated* where only one may be), one at an earlier place is out of *order*, one without a
place is *unknown*; required places that no child took are *missing*.  Documents are taken
apart once, in Arrow batches; the automata run inside generated code.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of each element: name, fewest and most (0: any number), in the order of the public schema ISO 19139 (fixed values).
MODELS = {
    "MD_Metadata": [
        ("fileIdentifier", 1, 1), ("language", 1, 0), ("characterSet", 0, 0), ("hierarchyLevel", 0, 0), ("contact", 1, 0), ("dateStamp", 1, 1), ("metadataStandardName", 0, 1), ("metadataStandardVersion", 0, 1),
        ("spatialRepresentationInfo", 0, 0), ("referenceSystemInfo", 0, 0), ("identificationInfo", 1, 0), ("distributionInfo", 0, 1), ("dataQualityInfo", 0, 0), ("metadataConstraints", 0, 0),
    ],
    "CI_ResponsibleParty": [("individualName", 0, 1), ("organisationName", 0, 1), ("positionName", 0, 1), ("contactInfo", 0, 1), ("role", 0, 1)],
    "EX_GeographicBoundingBox": [("extentTypeCode", 0, 1), ("westBoundLongitude", 1, 1), ("eastBoundLongitude", 1, 1), ("southBoundLatitude", 1, 1), ("northBoundLatitude", 1, 1)],
}
SEQUENCES = T.ArrayType(T.StructType([T.StructField("element", T.StringType()), T.StructField("inside", T.StringType()), T.StructField("children", T.ArrayType(T.StringType()))]))


def child_sequences(text: str | None) -> list[dict] | None:
    """Each element that has a model, in document order, with the name of the element around it and its children's names; null if the text is no document."""
    try:
        root = ElementTree.fromstring((text or "").strip())
    except ElementTree.ParseError:
        return None
    name, out, stack = lambda e: e.tag.rsplit("}", 1)[-1], [], [(root, None)]
    while stack:
        e, around = stack.pop()
        inner = [c for c in e if isinstance(c.tag, str)]
        if name(e) in MODELS or around is None:
            out.append({"element": name(e), "inside": around, "children": [name(c) for c in inner]})
        stack += [(c, name(e)) for c in reversed(inner)]
    return out


@F.pandas_udf(SEQUENCES)
def _sequences(x: pd.Series) -> pd.Series:
    return x.map(child_sequences)


def sequences(x: Column) -> Column:
    return _sequences(x)


def model_problems(children: Column, element: str) -> Column:
    """Violations of one model, in the order of the children and then of the places: an array like ``order dateStamp``."""
    model = MODELS[element]
    names, most = F.array(*[F.lit(n) for n, _, _ in model]), F.array(*[F.lit(m) for _, _, m in model])
    place = F.transform(children, lambda c: F.struct(c.alias("name"), F.array_position(names, c).cast("int").alias("p")))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("said"))

    def step(a: Column, c: Column) -> Column:
        once = F.get(most, c["p"] - 1) == 1
        wrong = F.when(c["p"] == 0, "unknown").when(c["p"] < a["state"], "order").when((c["p"] == a["state"]) & once, "repeated")
        return F.struct(F.greatest(a["state"], c["p"]).alias("state"), F.when(wrong.isNotNull(), F.array_append(a["said"], F.concat(wrong, F.lit(" "), c["name"]))).otherwise(a["said"]).alias("said"))

    needed = F.array(*[F.lit(n) for n, least, _ in model if least]) if any(least for _, least, _ in model) else F.array().cast("array<string>")
    missing = F.transform(F.array_except(needed, children), lambda n: F.concat(F.lit("missing "), n))
    return F.concat(F.aggregate(place, start, step)["said"], missing)


def content_problems(document: Column) -> Column:
    """Violations in a document (``sequences`` of it), as ``element: violation``; a root without a model is one, null if it is no document."""
    def of(s: Column) -> Column:
        found = F.when(s["inside"].isNull() & ~s["element"].isin(*MODELS), F.array(F.lit("no such root")))
        for element in MODELS:
            found = found.when(s["element"] == element, model_problems(s["children"], element))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.concat(s["element"], F.lit(": "), x))

    return F.flatten(F.transform(document, of))
