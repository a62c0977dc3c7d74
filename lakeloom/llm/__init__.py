"""Training-data operators: deduplication, filtering, extraction and tokenization on Spark.

Nothing outside this subpackage imports it.
"""
