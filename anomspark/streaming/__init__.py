"""Streaming.

The reference is batch only: it has no watermark, window, state or late-data handling,
so nothing is built here.  Fitted feature specs and detector parameters are plain
values; scoring a stream would be a ``foreachBatch`` over the same transforms.
"""
