"""Confluence: screening of large universes of daily price series as Spark DataFrames."""
