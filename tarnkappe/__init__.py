"""Pseudonymisation of names and contact data in large text collections, on Spark DataFrames."""
