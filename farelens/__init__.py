"""Bid-pricing analytics on Spark.

Every operator is a function from DataFrame to DataFrame, or from Column to
Column, so Catalyst sees one declarative plan per query.
"""
