"""Training-data operators: deduplication, tokenising, mixing, sharding, chat formatting, media and quality.

Nothing outside this subpackage imports it. Each operator takes DataFrames and returns DataFrames; the thin
queries that bind operators to the driver's tables live in :mod:`strandspark.llm.queries`.
"""
