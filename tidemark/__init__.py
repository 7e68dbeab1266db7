"""Tidemark: analytics of event and trade flow on Spark DataFrames."""
