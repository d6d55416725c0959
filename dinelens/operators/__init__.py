"""Relational jobs and queries, each a function of DataFrames."""
