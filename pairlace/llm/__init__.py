"""Operators of a training-data pipeline: documents in, documents or verdicts out."""
