"""plateflow: licence-plate recognition data processing on Spark DataFrames."""
