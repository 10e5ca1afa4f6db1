"""Operators of a training-data pipeline, each one a Spark job over whole tables and whole texts.

Nothing outside this package imports it.
"""
