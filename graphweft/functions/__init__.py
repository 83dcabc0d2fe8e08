"""Scalar functions of queries, as Spark columns."""
