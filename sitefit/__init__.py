"""Rule-based placement analytics for many city sites at once, on Spark DataFrames."""
