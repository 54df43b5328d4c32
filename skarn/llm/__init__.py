"""Training-data operators: packing, dedup, scans, search, counts, language ID.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names, keeps its own internal names (so extra or clashing input
columns do no harm) and reads the shared scratch folder from
``spark.checkpoint.dir``.
"""
