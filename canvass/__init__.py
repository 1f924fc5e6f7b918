"""Survey and event analytics on Spark.

Every operator takes and returns DataFrames and is built from Spark SQL
functions only, so the same code runs on tables and on streams.
"""
