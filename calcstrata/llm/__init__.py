"""Operators for large training-data pipelines: one module per operator.

Nothing outside this folder imports it. ``queries`` registers one query for
each operator; the operators themselves are plain functions on DataFrames.
"""
