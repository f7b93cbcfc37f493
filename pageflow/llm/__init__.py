"""Training-data operators: scoring, packing, deduplication, decontamination.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `queries` binds them to the tables with production parameters.
"""
