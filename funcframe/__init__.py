"""Functional datasets on Spark DataFrames."""
