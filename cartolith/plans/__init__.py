"""Whole plans: validation of a set of files, conversion of a layer."""
