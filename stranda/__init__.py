"""Location-annotated analytics on Spark DataFrames."""
