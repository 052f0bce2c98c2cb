"""Structured Streaming twins of the stateful operators.

Spark drops rows behind the watermark of the previous micro-batch, and a row equal to it;
the batch operators are exact against arrival order.  Stream and batch agree on in-order
input for all windows that a later event closed.
"""
