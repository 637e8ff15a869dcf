"""Operators over the catalog tables of many files at once; every table has a `file` column."""
