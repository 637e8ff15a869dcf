"""Operators for preparing text for model training, one module each.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, keeps no state on the driver that grows with the corpus and
writes intermediate tables only below the shared folder in
``spark.checkpoint.dir``.
"""
