"""Causeway: event-driven market analytics expressed on Spark DataFrames."""
