"""Retrieval, context packing and evaluation as batched Spark DataFrame operators."""
