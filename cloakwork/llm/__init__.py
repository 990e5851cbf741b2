"""Training-data operators over document tables.

Nothing outside this subpackage imports it; every operator takes and returns
DataFrames and has a thin ``opN_<name>`` query in :mod:`cloakwork.llm.queries`.
"""
