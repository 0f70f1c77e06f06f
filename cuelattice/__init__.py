"""Timed-transcript corpus analytics on Spark DataFrames."""
