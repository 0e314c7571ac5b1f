"""Structured Streaming ingestion.

The reference analyses uploaded files; the streaming form watches a
folder (or glob) of arriving files and profiles every micro-batch with
the batch operators inside ``foreachBatch``.
"""
