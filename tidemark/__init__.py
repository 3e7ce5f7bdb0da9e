"""Batch and incremental table pipelines on Spark.

Snapshots and change logs of operational tables become current-state tables,
cleaned tables and a star schema. Every operator is a function from DataFrame to
DataFrame made of built-in Spark functions; the caller owns the session.
"""
