"""Training-data operators: deduplication, sharding, tokens, archives, scans.

Each module holds one operator with a general DataFrame interface; the thin
queries over the standard tables are in :mod:`lexiflow.llm.queries`.
"""
