"""Quillstone: document analytics on Spark DataFrames."""
