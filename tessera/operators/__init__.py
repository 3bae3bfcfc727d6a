"""Joins, reports, series, similarity and grouping on DataFrames."""
