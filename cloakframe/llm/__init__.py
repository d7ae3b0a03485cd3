"""Training-data pipeline operators: extraction, filters, deduplication, tokens, archives.

Every module here depends on Spark, numpy and the standard library alone, and nothing
outside this folder (and ``corpus_pipeline.py``) imports it.
"""
