"""Cleaning, timeline and journey analytics for user event logs on Spark.

Every operator takes DataFrames and returns a DataFrame, so it can be chained
with ``df.transform(...)``. See the README for the list.
"""
