"""Data quality, conversion and roll-up of geospatial container files as Spark plans."""
