"""python -m cartolith validate PATH [--output FOLDER] [--rollup FOLDER [--batch N]] [--recursive] [--as-of STAMP]
python -m cartolith layers PATH
python -m cartolith finalise PATH [--recursive]
python -m cartolith convert SOURCE FOLDER --title ... --abstract ... [--layer NAME] [--file NAME] [--mode a|b|keep] [--profile NAME]

``convert`` takes GeoJSON, shapefiles and GeoPackages (all their layers unless ``--layer`` names one).  ``--rollup``
writes facts, one JSON object a file and the CSV over all batches below the folder.
``validate`` prints the verdict of each file and exits with 1 if any requirement of any file
fails or could not be checked, or if a file could not be read.
"""

from __future__ import annotations

import argparse
import datetime
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cartolith", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    v = commands.add_parser("validate")
    v.add_argument("path")
    v.add_argument("--output")
    v.add_argument("--rollup")
    v.add_argument("--batch", type=int, default=0)
    v.add_argument("--recursive", action="store_true")
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    v.add_argument("--as-of", default=now)
    c = commands.add_parser("convert")
    c.add_argument("source")
    c.add_argument("output")
    c.add_argument("--layer")
    c.add_argument("--file")
    c.add_argument("--mode", default="keep", choices=("a", "b", "keep"))
    c.add_argument("--profile", default="default")
    c.add_argument("--srs-id", type=int, default=4326)
    c.add_argument("--title", required=True)
    c.add_argument("--abstract", default="")
    c.add_argument("--language")
    c.add_argument("--stamp", default=now)
    final = commands.add_parser("finalise")
    final.add_argument("path")
    final.add_argument("--recursive", action="store_true")
    listing = commands.add_parser("layers")
    listing.add_argument("path")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cartolith").getOrCreate()
    if args.command == "convert":
        if len(args.title.strip()) < 5:
            parser.error("the title needs five characters or more")
        for r in _convert(spark, args, parser):
            print(r)
        return 0
    if args.command == "finalise":
        from .plans.finalise import finalise

        done = finalise(spark, args.path, recursive=args.recursive)
        for r in sorted(done, key=lambda r: r["file"]):
            print(f"{r['file']}: {'not changed: ' + r['error'] if r['error'] else ', '.join(r['changes']) or 'nothing to do'}")
        return int(any(r["error"] for r in done))
    if args.command == "layers":
        from .sources.gpkg import list_layers

        for r in list_layers(spark, args.path).orderBy("file", "table_name").toLocalIterator():
            print(f"{r.file}: {r.table_name} ({r.data_type}, {r.geometry_type or 'no geometry'}, system {r.organization}:{r.code}, {r.n} rows): {', '.join(f.name for f in r.fields)}")
        return 0

    from .operators import scoring
    from .plans.report import write_findings
    from .plans.validate import findings, scratch_folder
    from .sources import gpkg

    catalog = gpkg.read_catalog(spark, args.path, recursive=str(args.recursive).lower()).written(scratch_folder(spark, "validate"))
    if args.rollup:
        from .plans.rollup import write_reports

        facts = write_reports(catalog, args.as_of, args.rollup, batch=args.batch)
    else:
        facts = findings(catalog, args.as_of).cache()
    if args.output:
        write_findings(facts, args.output)
    unread = gpkg.read_table(spark, args.path, "__files__", recursive=str(args.recursive).lower()).filter("not ok").select("file", "error").collect()
    for r in scoring.file_verdicts(facts).orderBy("file").toLocalIterator():
        print(f"{r.file}: {r.verdict} ({r.n_pass} passed, {r.n_pass_star} in part, {r.n_fail} failed, {r.n_skipped} skipped)")
    for r in unread:
        print(f"{r.file}: not read: {r.error}")
    bad = scoring.gate(facts).filter("exit_code = 1").limit(1).count()
    return int(bool(bad or unread))


def _convert(spark, args, parser) -> list[dict]:
    """Convert by what the source holds."""
    from .plans import convert
    from .sources import shapefile
    from .sources.detect import kind_of

    kind, what = kind_of(args.source)
    if kind != "vector":
        parser.error(f"{args.source}: {what}")
    given = dict(title=args.title, abstract=args.abstract or f"Converted from {args.source}", stamp=args.stamp, language=args.language, file=args.file, mode=args.mode, profile=args.profile)
    if what == "gpkg":
        return convert.convert_geopackage(spark, args.source, args.output, layers=[args.layer] if args.layer else None, **given)
    if what == "shp":
        shapefile.register(spark)
        rows = spark.read.format("shp").load(path=args.source)
        given["srs_id"] = shapefile.system_of(args.source) or args.srs_id
    else:
        rows, given["srs_id"] = convert.read_geojson(spark, args.source), args.srs_id
    return [convert.convert_layer(rows.drop("file"), args.output, layer=args.layer or "layer", **given)]


if __name__ == "__main__":
    sys.exit(main())
