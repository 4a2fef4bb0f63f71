"""Millrace: select-project-join analytics on PySpark DataFrames."""
