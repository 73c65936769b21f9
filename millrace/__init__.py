"""millrace: declarative record flows compiled to Spark DataFrames."""
