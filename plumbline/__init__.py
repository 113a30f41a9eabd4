"""Plumbline: profile, map, load and reconcile tables with Spark DataFrames."""
