"""Document-fact analytics as Spark DataFrames."""
